"""One query for each rule and each fix, over files that a fixed template makes from the suppliers, each with SQL that says what has to be found.

A supplier's key picks one of five variants of a file, and how many blank lines stand before its text:
0 the faulty text, added; 1 the faulty text, of which only one line that the rule should see is new; 2 the faulty text, of which only a line elsewhere is new;
3 the sound text, added; 4 the sound text, modified, all lines new. Each file is a repository of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators import fixes, rules_markup, rules_resx, rules_text
from changeloom.plans import engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BAD, GOOD = (0, 1, 2), (3, 4)


@dataclass
class Case:
    rule: str
    severity: str
    line: int  # that is reported, in the faulty text
    touch: int  # the line that is new in variant 1
    bad: str
    good: str
    path: str = "src/F.cs"
    found: tuple[int, ...] = (0, 1)  # the variants in which it is found
    line_of: dict[int, int] = field(default_factory=dict)  # where a variant's line is another
    fixed: bool = False  # the line doesn't move with the blank lines before the text
    beside: tuple[tuple[str, str, str, tuple[int, ...]], ...] = ()  # status, path, text, variants: other files of the change
    repository: tuple[str, str] | None = None
    after: str | None = None  # the faulty text once it is fixed
    collapses: bool = False  # the fix makes one of several blank lines near it


def _body(*lines: str) -> str:
    return "class A\n{\n    void M()\n    {\n" + "".join(f"        {s}\n" for s in lines) + "    }\n}\n"


def _type(*lines: str, name: str = "class A") -> str:
    return f"{name}\n{{\n" + "".join(f"    {s}\n" for s in lines) + "}\n"


def _resx(*values: str) -> str:
    return "<root>\n" + "".join(f'  <data name="k{i}">\n    <value>{v}</value>\n  </data>\n' for i, v in enumerate(values)) + "</root>\n"


def _markup(*lines: str) -> str:
    return '<W xmlns="w">\n' + "".join(f"  {s}\n" for s in lines) + "</W>\n"


_BLOCK = "".join(f"    int Value{i} = Compute({i}, {i * i});\n" for i in range(7))
_PLAIN = _type("int x;")

CASES = [
    Case("empty-catch", "Important", 6, 8, _body("try { B(); }", "catch", "{", "}"), _body("try { B(); }", "catch", "{", "    throw;", "}")),
    Case("swallowing-catch", "Important", 6, 8, _body("try { B(); }", "catch (Exception e)", "{", "    return true;", "}"), _body("try { B(); }", "catch (Exception e)", "{", "    Show(e);", "}")),
    Case("lock-this-or-public", "Important", 5, 5, _body("lock (this) { B(); }"), _body("lock (gate) { B(); }")),
    Case("blank-line-between-brace-pairs", "Hint", 8, 7, "class A\n{\n    void M()\n    {\n        B();\n    }\n\n}\n", _body("B();"), after=_body("B();")),
    Case("missing-xml-docs", "Hint", 2, 3, "using System;\n\npublic class A\n{\n}\n", "/// <summary>Text.</summary>\n[Obs]\npublic class A\n{\n}\n", found=(0,)),
    Case("missing-typed-binding-context", "Hint", 3, 3, _markup("<T", '  Text="{Binding Name}"/>'), _markup("<T", '  Text="{Binding Name, ElementName=b}"/>'), path="src/V.axaml"),
    Case("public-method-argument-guards", "Hint", 3, 3, _type("public void M(string s)", "{", "    s.Trim();", "}"), _type("public void M(string s)", "{", "    if (s == null) return;", "    s.Trim();", "}")),
    Case("resx-empty-translation-values", "Suggestion", 6, 6, _resx("ja", ""), _resx("ja", "nee"), path="src/S.nl.resx"),
    Case("resx-value-boundary-whitespace", "Suggestion", 6, 6, _resx("yes", " no"), _resx("yes", "no"), path="src/S.resx"),
    Case("resx-mixed-english-dialect", "Suggestion", 3, 3, _resx("color behavior", "colour behaviour"), _resx("color", "colour behaviour"), path="src/S.resx", found=BAD),
    Case("resx-american-english-in-british-locale", "Suggestion", 6, 3, _resx("fine", "color", "center"), _resx("fine", "color"), path="src/S.en-GB.resx", found=BAD),
    Case("resx-british-english-in-american-locale", "Suggestion", 6, 3, _resx("fine", "colour", "centre"), _resx("fine", "colour"), path="src/S.en-US.resx", found=BAD),
    Case("resx-missing-locale-keys", "Suggestion", 1, 1, _resx("a"), _resx("a", "b"), path="src/S.fr.resx", found=(0,), fixed=True, beside=(("M", "src/S.resx", _resx("a", "b"), (0, 1, 2, 3, 4)),)),
    Case("resx-unexpected-extra-keys", "Hint", 1, 1, _resx("a", "b"), _resx("a"), path="src/S.fr.resx", found=(0,), fixed=True, beside=(("M", "src/S.resx", _resx("a"), (0, 1, 2, 3, 4)),)),
    Case("empty-container", "Hint", 2, 2, _markup("<Grid", '  Margin="1"/>'), _markup("<Grid>", "  <A/>", "  <B/>", "</Grid>"), path="src/V.axaml"),
    Case("fixed-size-layout-container", "Suggestion", 2, 3, _markup("<StackPanel", '  Width="3">', "  <A/>", "  <B/>", "</StackPanel>"), _markup("<StackPanel>", "  <A/>", "  <B/>", "</StackPanel>"), path="src/V.axaml"),
    Case("single-child-wrapper-container", "Hint", 2, 2, _markup("<Grid>", "  <A/>", "</Grid>"), _markup("<Grid>", "  <A/>", "  <B/>", "</Grid>"), path="src/V.axaml"),
    Case("nested-same-panel-wrapper", "Hint", 2, 3, _markup("<Grid>", "  <Grid>", "    <A/>", "    <B/>", "  </Grid>", "</Grid>"), _markup("<Grid>", "  <A/>", "  <B/>", "</Grid>"), path="src/V.axaml"),
    Case("missing-disclaimer-for-new-source-file", "Hint", 1, 1, _PLAIN, "// Copyright by all of us\n" + _PLAIN, found=(0,), fixed=True, beside=(("M", "src/Old.cs", "// Copyright by all of us\nclass Old { }\n", (0, 1, 2, 3, 4)),)),
    Case("missing-readme-for-new-project", "Hint", 1, 1, "<Project/>\n", "<Project/>\n", path="src/P.csproj", found=(0,), fixed=True, beside=(("A", "src/README.md", "text\n", GOOD),)),
    Case("missing-tests", "Suggestion", 1, 1, "public class A\n{\n}\n", "public class A\n{\n}\n", found=(0,), fixed=True, beside=(("A", "test/ATests.cs", "class ATests { }\n", GOOD),)),
    Case("missing-tests-public-methods", "Suggestion", 3, 3, _type("[Obs]", "public void M()", "{", "}"), _type("public void M()", "{", "}"), beside=(("M", "test/ATests.cs", "class ATests { }\n", GOOD),)),
    Case("duplicate-code-block", "Suggestion", 3, 3, "class A\n{\n" + _BLOCK + "}\n", _PLAIN, found=(0,), repository=("src/Other.cs", "class Other\n{\n" + _BLOCK + "}\n")),
    Case("async-void", "Important", 3, 3, _type("[Obs]", "public async void Go(int a)", "{", "    B();", "}"), _type("public async Task GoAsync(int a)", "{", "    B();", "}")),
    Case("async-method-name-suffix", "Hint", 3, 3, _type("[Obs]", "public async Task Go()", "{", "    B();", "}"), _type("public async Task GoAsync()", "{", "    B();", "}")),
    Case("property-can-be-auto-property", "Hint", 4, 4, _type("int m;", "public int X", "{", "    get { return m; }", "    set { m = value; }", "}"), _type("public int X { get; set; }")),
    Case("private-get-only-auto-property-should-be-field", "Hint", 3, 3, _type("private int X { get; }"), _type("public int X { get; }")),
    Case("private-property-should-be-field", "Hint", 3, 3, _type("private int X { get; set; }"), _type("public int X { get; set; }")),
    Case("missing-blank-line-between-methods", "Hint", 6, 8, _type("void M()", "{", "}", "void N()", "{", "    B();", "}"), _type("void M()", "{", "}", "", "void N()", "{", "    B();", "}"), after=_type("void M()", "{", "}", "void N()", "{", "    B();", "}").replace("    }\n    void N", "    }\n\n    void N")),
    Case("method-parameter-count", "Hint", 3, 3, _type("public void M(int a, int b, int c, int d,", "    int e, int f, int g, int h)", "{", "}"), _type("public void M(int a, int b, int c, int d,", "    int e, int f, int g)", "{", "}")),
    Case("generic-type-name-suffix", "Hint", 1, 1, _type(name="[Obs]\nclass FooHelper"), _type(name="[Obs]\nclass HelperFoo")),
    Case("if-else-brace-consistency", "Suggestion", 5, 9, _body("if (a)", "    B();", "else", "{", "    C();", "    D();", "}"), _body("if (a)", "    B();", "else", "    C();"), after=_body("if (a)", "{", "    B();", "}", "else", "{", "    C();", "    D();", "}")),
    Case("if-else-unnecessary-braces", "Hint", 5, 7, _body("if (a)", "{", "    B();", "}", "else", "{", "    C();", "}"), _body("if (a)", "    B();", "else", "    C();"), after=_body("if (a)", "    B();", "else", "    C();")),
    Case("constructor-too-long", "Suggestion", 3, 15, _type("[Obs]", "public A()", "{", *["    X();"] * 20, "}"), _type("[Obs]", "public A()", "{", *["    X();"] * 19, "    // c", "", "}")),
    Case("thread-sleep", "Suggestion", 5, 5, _body("Thread.Sleep(1);"), _body("x.Sleep(1);")),
    Case("throw-ex-in-catch", "Important", 8, 8, _body("try { B(); }", "catch (Exception ex)", "{", "    throw ex;", "}"), _body("try { B(); }", "catch (Exception ex)", "{", "    throw;", "}"), after=_body("try { B(); }", "catch (Exception ex)", "{", "    throw;", "}")),
    Case("public-mutable-static-state", "Important", 3, 3, _type("public static int X;"), _type("public static readonly int X;")),
    Case("empty-xml-doc-content", "Hint", 1, 2, "/// <summary>\n/// </summary>\n" + _PLAIN, "/// <summary>\n/// Text.\n/// </summary>\n" + _PLAIN),
    Case("multiple-classes-per-file", "Hint", 5, 8, "class A\n{\n}\n\n[Obs]\nclass B\n{\n    int x;\n}\n", "class A\n{\n    class B\n    {\n    }\n}\n"),
    Case("warning-suppression", "Important", 1, 1, "#pragma warning disable CS1\n" + _PLAIN, "#pragma warning restore CS1\n" + _PLAIN, after=_PLAIN, collapses=True),
    Case("consecutive-boolean-arguments", "Hint", 6, 10, _body("Go(", "    true,", "    false,", "    1,", "    true,", "    false);", "var o = new Foo(true, false);"), _body("Go(true, 1, false);", "var o = new Foo(true, false);", "Go(a: true, b: false);"), line_of={1: 9}),
    Case("consecutive-null-arguments", "Hint", 6, 10, _body("Go(", "    null,", "    null,", "    1,", "    null,", "    null);", "var o = new Foo(null, null);"), _body("Go(null, 1, null);", "var o = new Foo(null, null);"), line_of={1: 9}),
    Case("unnecessary-verbatim-string-prefix", "Hint", 3, 3, _type('string a = @"x";'), _type('string a = @"x\\y";'), after=_type('string a = "x";')),
    Case("local-variable-prefix", "Hint", 5, 5, _body("int _x = Go();", "B(_x);"), _body("int x = Go();", "B(x);")),
    Case("unnecessary-enum-member-value", "Hint", 3, 3, _type("A = 0,", "B,", "C = 5", name="enum E"), _type("A = 1,", "B,", "C = 5", name="enum E"), after=_type("A,", "B,", "C = 5", name="enum E")),
    Case("redundant-self-lookup", "Hint", 5, 5, _body("var f = A.GetA(this);", "B(f);"), _body("var f = C.GetC(this);", "B(f);"), after=_body("var f = this;", "B(f);")),
    Case("unused-private-member", "Hint", 3, 5, _type("private void N()", "{", "    B();", "}", "", "public int X;"), _type("private void N()", "{", "    B();", "}", "", "public void M()", "{", "    N();", "}"), after=_type("", "public int X;"), collapses=True),
    Case("unused-local-variable", "Hint", 5, 5, _body("int x = Go();", "x = 2;"), _body("int x = Go();", "B(x);")),
    Case("local-variable-can-be-const", "Hint", 5, 5, _body("int n = -1;", "B(n);"), _body("int n = 1;", "n++;", "B(n);"), after=_body("const int n = -1;", "B(n);")),
    Case("string-concat-same-target", "Suggestion", 6, 7, _body('string s = "";', "s += 1;", "s += 2;", "s += 3;", "s += 4;", "B(s);"), _body('string s = "";', "s += 1;", "s += 2;", "s += 3;", "B(s);"), found=(0,)),
    Case("private-field-can-be-readonly", "Hint", 3, 3, _type("private int x;", "public A()", "{", "    x = 1;", "}", "int Get()", "{", "    return x;", "}"), _type("private int x;", "void Set()", "{", "    x = 1;", "}", "int Get()", "{", "    return x;", "}")),
    Case("private-field-used-in-single-method", "Hint", 3, 3, _type("private readonly int x;", "public A(int v)", "{", "    x = v;", "    B(x);", "}"), _type("private readonly int x;", "public A(int v)", "{", "    x = v;", "}", "int Get()", "{", "    return x;", "}")),
    Case("method-can-be-static", "Hint", 3, 3, _type("private int N(int a)", "{", "    return a + 1;", "}"), _type("int x;", "private int N(int a)", "{", "    return a + x;", "}"), after=_type("private static int N(int a)", "{", "    return a + 1;", "}")),
    Case("task-run-async", "Suggestion", 5, 5, _body("Task.Run(async () => { });"), _body("Task.Run(() => Go());")),
    Case("constructor-event-subscription-lifecycle", "Important", 3, 5, _type("public A()", "{", "    x.Changed += OnChanged;", "}"), _type("public A()", "{", "    x.Changed += OnChanged;", "}", "public void Dispose()", "{", "    x.Changed -= OnChanged;", "}", name="class A : IDisposable")),
    Case("disposable-not-disposed", "Suggestion", 5, 5, _body("var s = new FileStream(p);", "s.Read();"), _body("using var s = new FileStream(p);", "s.Read();")),
    Case("dispose-without-idisposable", "Suggestion", 3, 5, _type("public void Dispose()", "{", "    B();", "}"), _type("public void Dispose()", "{", "    B();", "}", name="class A : IDisposable")),
    Case("boolean-literal-comparison", "Hint", 5, 5, _type("void M(bool b)", "{", "    if (b == true) B();", "}"), _type("void M(bool? b)", "{", "    if (b == true) B();", "}")),
    Case("unnecessary-cast", "Hint", 5, 5, _type("void M(int a)", "{", "    var b = (int)a;", "    B(b);", "}"), _type("void M(int a)", "{", "    var b = (long)a;", "    B(b);", "}")),
    Case("unobserved-task-result", "Suggestion", 9, 9, _type("Task Go()", "{", "    return Later();", "}", "void M()", "{", "    Go();", "}"), _type("Task Go()", "{", "    return Later();", "}", "void M()", "{", "    _ = Go();", "}")),
    Case("multiple-enumeration", "Suggestion", 6, 5, _type("void M(IEnumerable<int> x)", "{", "    B(x.Count());", "    B(x.Any());", "}"), _type("void M(List<int> x)", "{", "    B(x.Count());", "    B(x.Any());", "}"), found=(0,)),
    Case("numeric-string-culture-for-file-write", "Important", 5, 5, _type("void M(double d)", "{", '    File.WriteAllText("p", d.ToString());', "}"), _type("void M(double d)", "{", '    File.WriteAllText("p", d.ToString(CultureInfo.InvariantCulture));', "}")),
    Case("lambda-can-be-method-group", "Hint", 5, 5, _body("x.ForEach(i => Go(i));"), _body("x.ForEach(i => Go(i, 1));"), after=_body("x.ForEach(Go);")),
    Case("unused-usings-roslyn", "Hint", 3, 1, "using A;\nusing B;\nusing A;\n" + _PLAIN, "using A;\nusing B;\n" + _PLAIN, found=BAD, after="using A;\nusing B;\n" + _PLAIN, collapses=True),
]

_PER_FILE = {
    "empty-catch": rules_text.empty_catch, "swallowing-catch": rules_text.swallowing_catch, "lock-this-or-public": rules_text.lock_target, "blank-line-between-brace-pairs": rules_text.blank_between_braces,
    "missing-xml-docs": rules_text.missing_xml_docs, "missing-typed-binding-context": rules_text.untyped_bindings, "public-method-argument-guards": rules_text.argument_guards,
    "resx-empty-translation-values": rules_resx.empty_values, "resx-value-boundary-whitespace": rules_resx.boundary_whitespace,
    **dict.fromkeys(("resx-mixed-english-dialect", "resx-american-english-in-british-locale", "resx-british-english-in-american-locale"), rules_resx.dialects),
    "empty-container": rules_markup.empty_container, "fixed-size-layout-container": rules_markup.fixed_size, "single-child-wrapper-container": rules_markup.single_child, "nested-same-panel-wrapper": rules_markup.nested_same_panel,
}
_SEVERAL = {
    **dict.fromkeys(("resx-missing-locale-keys", "resx-unexpected-extra-keys"), engine.key_differences), "missing-disclaimer-for-new-source-file": engine.missing_disclaimer, "missing-readme-for-new-project": engine.missing_readme,
    "missing-tests": engine.missing_tests, "missing-tests-public-methods": engine.missing_method_tests, "duplicate-code-block": engine.duplicate_blocks,
}


def _in(values: tuple[int, ...]) -> Column:
    return F.col("variant").isin(*values)


def changed(spark: SparkSession, sf_dir: str, c: Case) -> DataFrame:
    """The change set of a case: one row for each supplier, and the files beside it."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("repo_id"), (F.col("s_suppkey") % 5).cast("int").alias("variant"), (F.col("s_suppkey") % 3).cast("int").alias("pad"))
    text = F.concat(F.repeat(F.lit("\n"), F.col("pad")), F.when(_in(BAD), c.bad).otherwise(c.good))
    every = F.sequence(F.lit(1), F.col("pad") + F.lit(max(c.bad.count("\n"), c.good.count("\n")) + 1))
    lines = F.when(F.col("variant") == 1, F.array(F.col("pad") + c.touch)).when(F.col("variant") == 2, F.array(F.lit(900))).otherwise(every)
    main = keys.select("repo_id", F.when(_in((0, 3)), "A").otherwise("M").alias("status"), F.lit(c.path).alias("path"), text.alias("text"), lines.cast("array<int>").alias("added_lines"))
    for status, path, other, variants in c.beside:
        main = main.unionByName(keys.where(_in(variants)).select("repo_id", F.lit(status).alias("status"), F.lit(path).alias("path"), F.lit(other).alias("text"), F.array(F.lit(1)).alias("added_lines")))
    return main


def _review(spark: SparkSession, sf_dir: str, c: Case) -> tuple[DataFrame, DataFrame]:
    files = changed(spark, sf_dir, c)
    repository = None
    if c.repository:
        repository = files.select("repo_id", F.lit(c.repository[0]).alias("path"), F.lit(c.repository[1]).alias("text")).distinct()
    per_file = [] if c.rule in _SEVERAL else [_PER_FILE.get(c.rule, engine.csharp_findings)]
    found = engine.review(files, repository, per_file=per_file, several_files=[_SEVERAL[c.rule]] if c.rule in _SEVERAL else [])
    return found.findings.where(F.col("rule_id") == c.rule), files


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _add(c: Case) -> None:
    name = c.rule.replace("-", "_")

    def rule(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _review(spark, sf_dir, c)[0].select("repo_id", "file_path", "rule_id", "line_number", "severity", "severity_rank")

    rule.__name__ = f"rule_{name}"
    rank = ("Ok", "Hint", "Suggestion", "Important").index(c.severity)
    line = "CASE s_suppkey % 5 " + " ".join(f"WHEN {v} THEN {c.line_of.get(v, c.line)}" for v in c.found) + " END" + ("" if c.fixed else " + s_suppkey % 3")
    QUERIES[rule.__name__] = rule
    SQL[rule.__name__] = (
        f"SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, {_sql(c.path)} AS file_path, {_sql(c.rule)} AS rule_id, CAST({line} AS INTEGER) AS line_number, {_sql(c.severity)} AS severity, CAST({rank} AS INTEGER) AS severity_rank"
        f" FROM supplier WHERE s_suppkey % 5 IN ({', '.join(map(str, c.found))})"
    )
    if c.after is None:
        return

    def fix(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, files = _review(spark, sf_dir, c)
        return fixes.fixed_files(found, files).select("repo_id", "path", "new_text", "fixed")

    fix.__name__ = f"fix_{name}"
    QUERIES[fix.__name__] = fix
    SQL[fix.__name__] = f"SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, {_sql(c.path)} AS path, repeat(chr(10), CAST({'least(1, s_suppkey % 3)' if c.collapses else 's_suppkey % 3'} AS BIGINT)) || {_sql(c.after)} AS new_text, TRUE AS fixed FROM supplier WHERE s_suppkey % 5 IN ({', '.join(map(str, c.found))})"


for _c in CASES:
    _add(_c)

"""Rules, each by small sources that it should and shouldn't complain about."""

import pytest
from pyspark.sql import functions as F

from changeloom import model
from changeloom.operators import csharp
from changeloom.plans import engine

#: rule, source, expected number of candidates
CSHARP = [
    ("async-void", "class A { async void M(int a) { } }", 1),
    ("async-void", "class A { async void On(object s, EventArgs e) { } public override async void Execute(object p) { } async Task M() { } }", 0),
    ("async-method-name-suffix", "class A { public async Task Load() { } }", 1),
    ("async-method-name-suffix", "class A { public async Task LoadAsync() { } public override async Task Go() { } [Test] public async Task T() { } async Task I.X() { } }", 0),
    ("property-can-be-auto-property", "class A { int m; public int X { get { return m; } set { m = value; } } }", 1),
    ("property-can-be-auto-property", "class A { int m; public int X { get => m; set => m = value; } }", 1),
    ("property-can-be-auto-property", "class A { int m; public int X { get { return m; } set { m = value; Go(); } } public int Y { get; set; } }", 0),
    ("private-get-only-auto-property-should-be-field", "class A { private int X { get; } }", 1),
    ("private-get-only-auto-property-should-be-field", "class A { public int X { get; } }", 0),
    ("private-property-should-be-field", "class A { private int X { get; set; } }", 1),
    ("private-property-should-be-field", "class A { private int X => 1; public int Y { get; set; } }", 0),
    ("missing-blank-line-between-methods", "class A {\nvoid M() {\n}\nvoid N() {\n}\n}", 1),
    ("missing-blank-line-between-methods", "class A {\nvoid M() {\n}\n\nvoid N() {\n}\n}", 0),
    ("method-parameter-count", "class A { void M(int a, int b, int c, int d, int e, int f, int g, Dictionary<int, int> h) { } }", 1),
    ("method-parameter-count", "class A { void M(Dictionary<int, int> a, (int, int) b, int c, int d, int e, int f, int g) { } }", 0),
    ("generic-type-name-suffix", "class FooHelper { }", 1),
    ("generic-type-name-suffix", "interface FooHelper { } class HelperFoo { }", 0),
    ("if-else-brace-consistency", "class A { void M() { if (a) B(); else { C(); } } }", 1),
    ("if-else-brace-consistency", "class A { void M() { if (a) B(); else if (c) { D(); } if (a) { } } }", 0),
    ("if-else-unnecessary-braces", "class A { void M() { if (a) { B(); } else { C(); } } }", 1),
    ("if-else-unnecessary-braces", "class A { void M() { if (a) { B(); /* why */ } else { C(); } if (a) { B(); D(); } else { C(); } } }", 0),
    ("constructor-too-long", "class A { public A() {\n" + "X();\n" * 20 + "} }", 1),
    ("constructor-too-long", "class A { public A() {\n" + "X();\n" * 18 + "// c\n\n} }", 0),
    ("thread-sleep", "class A { void M() { Thread.Sleep(1); } }", 1),
    ("thread-sleep", "using static System.Threading.Thread;\nclass A { void M() { Sleep(1); } }", 1),
    ("thread-sleep", "class A { void M() { Sleep(1); x.Sleep(2); } }", 0),
    ("throw-ex-in-catch", "class A { void M() { try { } catch (Exception ex) { throw ex; } } }", 1),
    ("throw-ex-in-catch", "class A { void M() { try { } catch (Exception ex) { throw; } try { } catch (Exception e) { throw other; } } }", 0),
    ("public-mutable-static-state", "class A { public static int X; public static int Y { get; set; } }", 2),
    ("public-mutable-static-state", "class A { public static readonly int X; public const int Z = 1; public static int Y { get; private set; } static int W; }", 0),
    ("empty-xml-doc-content", "/// <summary> </summary>\n/// <param name=\"x\"></param>\nclass A { }", 2),
    ("empty-xml-doc-content", "/// <summary>\n/// Text.\n/// </summary>\nclass A { }", 0),
    ("multiple-classes-per-file", "class A { class Inner { } }\nclass B { }", 1),
    ("multiple-classes-per-file", "class A { class Inner { } } interface I { }", 0),
    ("warning-suppression", "#pragma warning disable CS1\n[SuppressMessage(\"a\", \"b\")]\nclass A { }", 2),
    ("warning-suppression", "#pragma warning restore CS1\nclass A { string s = \"#pragma warning disable\"; }", 0),
    ("consecutive-boolean-arguments", "class A { void M() { Go(1, true, false); } }", 1),
    ("consecutive-boolean-arguments", "class A { void M() { Go(true, 1, false); Go(a: true, b: false); } }", 0),
    ("consecutive-null-arguments", "class A { void M() { Go(null, null); } }", 1),
    ("consecutive-null-arguments", "class A { void M() { Go(null); } }", 0),
    ("unnecessary-verbatim-string-prefix", 'class A { string a = @"x"; string b = $@"y"; }', 2),
    ("unnecessary-verbatim-string-prefix", 'class A { string a = @"x\\y"; string b = @"a""b"; string c = "x"; }', 0),
    ("local-variable-prefix", "class A { void M() { int _x = Go(); int m_y = Go(); } }", 2),
    ("local-variable-prefix", "class A { int _x; void M() { int x = Go(); _ = Go(); } }", 0),
    ("unnecessary-enum-member-value", "enum E { A = 0, B, C = 2, D = 7, E = 0x8 }", 3),
    ("unnecessary-enum-member-value", "enum E { A = 1, B = 1 << 1, C = 5 }", 0),
    ("redundant-self-lookup", "class Foo { void M() { var f = Foo.GetFoo(this); } }", 1),
    ("redundant-self-lookup", "class Foo { void M() { var f = Bar.GetBar(this); } }", 0),
    ("unused-private-member", "class A { private int x; void M() { } }", 2),
    ("unused-private-member", 'class A { private int x; public string S => $"{x}"; } partial class B { private int y; }', 0),
    ("unused-local-variable", "class A { void M() { int x = 1; x = 2; } }", 1),
    ("unused-local-variable", "class A { void M() { int x = 1; Go(x); } }", 0),
    ("local-variable-can-be-const", 'class A { void M() { var s = "a"; int n = -1; Go(s, n); } }', 2),
    ("local-variable-can-be-const", "class A { void M() { int n = 1; n++; const int k = 1; Go(n, k, out int z); } }", 0),
    ("string-concat-same-target", 'class A { void M() { string s = ""; s += 1; s += 2; s = s + 3; s += 4; } }', 1),
    ("string-concat-same-target", "class A { void M() { int s = 0; s += 1; s += 2; s += 3; s += 4; } }", 0),
    ("private-field-can-be-readonly", "class A { int x; public A() { x = 1; } int Get() => x; }", 1),
    ("private-field-can-be-readonly", "class A { int x; readonly int y; void Set() { x = 1; } void Ref() { Go(ref y); } }", 0),
    ("private-field-used-in-single-method", "class A { readonly int x; public A(int v) { x = v; Go(x); } }", 1),
    ("private-field-used-in-single-method", "class A { readonly int x; public A(int v) { x = v; } int Get() => x; }", 0),
    ("method-can-be-static", "class A { int x; private int M(int a) { return a + 1; } }", 1),
    ("method-can-be-static", "class A : B { int x; private int M() { return x; } private void N() { Inherited(); } private void O() { this.P(); } }", 0),
    ("task-run-async", "class A { void M() { Task.Run(async () => { }); } }", 1),
    ("task-run-async", "class A { void M() { Task.Run(() => Go()); } }", 0),
    ("constructor-event-subscription-lifecycle", "class A { public A() { x.Changed += OnChanged; } }", 1),
    ("constructor-event-subscription-lifecycle", "class A : IDisposable { public A() { x.Changed += OnChanged; count += 1; } void Dispose() { x.Changed -= OnChanged; } }", 0),
    ("disposable-not-disposed", "class A { void M() { var s = new FileStream(p); s.Read(); } }", 1),
    ("disposable-not-disposed", "class A { void M() { using var s = new FileStream(p); var t = new FileStream(p); t.Dispose(); var u = new FileStream(p); return u; } }", 0),
    ("dispose-without-idisposable", "class A { public void Dispose() { } }", 1),
    ("dispose-without-idisposable", "class A : IDisposable { public void Dispose() { } } class B { public void Dispose(bool d) { } }", 0),
    ("boolean-literal-comparison", "class A { void M(bool b) { if (b == true) { } if (false != b) { } } }", 2),
    ("boolean-literal-comparison", "class A { void M(bool? b) { if (b == true) { } } }", 0),
    ("unnecessary-cast", "class A { void M(int a) { var b = (int)a; } }", 1),
    ("unnecessary-cast", "class A { void M(int a) { var b = (long)a; var c = (int)a.X; } }", 0),
    ("unobserved-task-result", "class A { Task Go() { } void M() { Go(); x.LoadAsync(); } }", 2),
    ("unobserved-task-result", "class A { Task Go() { } async Task M() { await Go(); _ = Go(); var t = Go(); } }", 0),
    ("multiple-enumeration", "class A { void M(IEnumerable<int> x) { x.Count(); foreach (var i in x) { } } }", 1),
    ("multiple-enumeration", "class A { void M(List<int> x) { x.Count(); x.Any(); } }", 0),
    ("numeric-string-culture-for-file-write", 'class A { void M(double d) { File.WriteAllText("p", d.ToString()); } }', 1),
    ("numeric-string-culture-for-file-write", 'class A { void M(double d, int i) { File.WriteAllText("p", d.ToString(CultureInfo.InvariantCulture)); File.WriteAllText("p", i.ToString()); } }', 0),
    ("lambda-can-be-method-group", "class A { void M() { x.ForEach(i => Go(i)); y.Do((a, b) => Sum(a, b)); } }", 2),
    ("lambda-can-be-method-group", "class A { void M() { x.ForEach(i => Go(i, 1)); x.ForEach(i => i.Go(i)); } }", 0),
    ("unused-usings-roslyn", "using A;\nusing B;\nusing A;\nclass C { }", 1),
    ("missing-tests-public-methods", "public class A { public void M() { } }", 1),
    ("missing-tests-public-methods", "interface A { public void M() { } } class D { public void Dispose() { } } public class B { public override string ToString() { } void N() { } }", 0),
]


@pytest.mark.parametrize("rule, source, n", CSHARP)
def test_csharp(rule, source, n):
    assert len([c for c in csharp.candidates(source) if c["rule_id"] == rule]) == n


@pytest.mark.parametrize("source", ["class A {", "class A { string s = \"x; }", "/* open", "class A { char c = '; }", ")(", "", "﻿class A { }", 'var s = $"{a + $"{b}"}";', 'class A { string s = """\nraw "x"\n"""; }'])
def test_broken_or_odd_sources_never_raise(source):
    assert isinstance(csharp.candidates(source), list)


def scan(spark, rows, **options):
    df = spark.createDataFrame([(*r, None) if len(r) == 3 else r for r in rows], "status string, path string, text string, added_lines array<int>")
    whole = F.when(F.col("added_lines").isNull(), F.sequence(F.lit(1), F.lit(200))).otherwise(F.col("added_lines"))
    return engine.review(df.withColumn("added_lines", whole), **options)


def found(review, rule=None):
    rows = review.findings.collect()
    return sorted((r.file_path, r.line_number, r.severity) for r in rows if rule is None or r.rule_id == rule)


CATCHES = {
    "a.cs": ("try { } catch { }", ("empty-catch", "Important")),
    "b.cs": ("try { } catch { // fine\n }", ("empty-catch", "Suggestion")),
    "c.cs": ("try { } catch (OperationCanceledException) { }", None),
    "d.cs": ("try { } catch (Exception e) { return true; }", ("swallowing-catch", "Important")),
    "e.cs": ("try { } catch (Exception e) { return null; }", ("swallowing-catch", "Hint")),
    "f.cs": ("try { } catch (Exception) { hasError = true; }", ("swallowing-catch", "Suggestion")),
    "g.cs": ("try { } catch { Logger.Warn(\"x\"); }", ("swallowing-catch", "Suggestion")),
    "h.cs": ("try { } catch { x.Dispose(); }", ("swallowing-catch", "Suggestion")),
    "i.cs": ("try { } catch { Foo(); }", ("swallowing-catch", "Important")),
    "j.cs": ("try { } catch (Exception e) { Show(e); }", None),
    "k.cs": ("try { } catch { Foo(); throw; }", None),
}


def test_catches(spark):
    got = {(r.file_path, r.rule_id, r.severity) for r in scan(spark, [("M", p, t) for p, (t, _) in CATCHES.items()]).findings.collect() if "catch" in r.rule_id}
    assert got == {(p, *e) for p, (_, e) in CATCHES.items() if e}


def test_lines_and_scope(spark):
    gate = "class A {\n public object Gate;\n void M() {\n lock(this) { }\n lock (Gate) { }\n lock (mine) { }\n}\n\n\n}\n"
    r = scan(spark, [("M", "x.cs", gate, [4, 5, 6, 9])])
    assert found(r, "lock-this-or-public") == [("x.cs", 4, "Important"), ("x.cs", 5, "Important")]
    assert found(r, "blank-line-between-brace-pairs") == [("x.cs", 10, "Hint")]
    assert found(scan(spark, [("M", "x.cs", gate, [1])]), "lock-this-or-public") == []
    assert len(found(scan(spark, [("M", "x.cs", gate, [1])], include_full_modified_files=True), "lock-this-or-public")) == 2
    assert found(scan(spark, [("M", "obj/Debug/x.cs", gate)])) == []


def test_types_tests_docs_headers(spark):
    rows = [("A", "s/Foo.cs", "public class Foo { }"), ("A", "s/Bar.cs", "/// <summary>x</summary>\n[Attr]\npublic class Bar { }"), ("A", "t/BarTests.cs", "[TestFixture] class BarTests { }"), ("A", "s/IThing.cs", "public interface IThing { }"), ("M", "s/Old.cs", "// Copyright\nclass Old { }"), ("A", "n/P.csproj", "<P/>"), ("A", "n/README.md", "x"), ("A", "m/Q.csproj", "<P/>")]
    r = scan(spark, rows)
    assert found(r, "missing-tests") == [("s/Foo.cs", 1, "Hint")]
    assert found(r, "missing-xml-docs") == [("s/Foo.cs", 1, "Hint"), ("s/IThing.cs", 1, "Hint")]
    assert [p for p, *_ in found(r, "missing-disclaimer-for-new-source-file")] == ["s/Bar.cs", "s/Foo.cs", "s/IThing.cs", "t/BarTests.cs"]
    assert "m/Q.csproj" in [p for p, *_ in found(r, "missing-readme-for-new-project")]
    assert found(scan(spark, rows[:1]), "missing-tests") == [("s/Foo.cs", 1, "Suggestion")]


def test_guards(spark):
    src = "public void A(string s)\n{\n s.Trim();\n}\npublic void B(string s)\n{\n if (s == null) return;\n s.Trim();\n}\npublic void C(int n, string o = null)\n{\n n.ToString();\n}\npublic static void Main(string[] args)\n{\n args.Any();\n}\n"
    assert found(scan(spark, [("M", "x.cs", src)]), "public-method-argument-guards") == [("x.cs", 1, "Hint")]
    assert found(scan(spark, [("M", "xTests.cs", src)]), "public-method-argument-guards") == []


def resx(*kv):
    return "<root>" + "".join(f'\n<data name="{k}"><value>{v}</value></data>' for k, v in kv) + "\n</root>"


def test_resx(spark):
    rows = [("A", "S.fr.resx", resx(("a", ""), ("z", "q"), ("z", "r"))), ("M", "S.resx", resx(("a", "color center colour centre"), ("b", " x"))), ("A", "S.en-GB.resx", resx(("a", "Color behavior"), ("b", "ok"))), ("M", "S.en-US.resx", resx(("a", "colour analyse"), ("b", "colours"))), ("A", "Bad.fr.resx", "<root>"), ("A", "D.resx", '<!DOCTYPE x><root/>')]
    r = scan(spark, rows)
    assert found(r, "resx-missing-locale-keys") == [("S.fr.resx", 1, "Suggestion")]
    assert found(r, "resx-unexpected-extra-keys") == [("S.fr.resx", 1, "Hint")]
    assert found(r, "resx-empty-translation-values") == [("S.fr.resx", 2, "Suggestion")]
    assert found(r, "resx-value-boundary-whitespace") == [("S.resx", 3, "Suggestion")]
    assert found(r, "resx-mixed-english-dialect") == [("S.resx", 2, "Suggestion")]
    assert found(r, "resx-american-english-in-british-locale") == [("S.en-GB.resx", 2, "Suggestion")]
    assert found(r, "resx-british-english-in-american-locale") == [("S.en-US.resx", 2, "Suggestion")]
    base = spark.createDataFrame([("T.resx", resx(("a", "x"), ("b", "y")))], "path string, text string")
    assert found(scan(spark, [("A", "T.de.resx", resx(("a", "x")))], repository=base), "resx-missing-locale-keys") == [("T.de.resx", 1, "Suggestion")]


MARKUP = '<W xmlns="w" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml">\n{}\n</W>'


@pytest.mark.parametrize(
    "body, rules",
    [
        ("<Grid/>", {"empty-container"}),
        ('<Grid x:Name="g"/><Grid Loaded="L"/><Grid FooChanged="F"/>', set()),
        ('<StackPanel Width="3"><A/><B/></StackPanel>', {"fixed-size-layout-container"}),
        ("<Grid><A/></Grid>", {"single-child-wrapper-container"}),
        ("<Grid><Grid><A/><B/></Grid></Grid>", {"nested-same-panel-wrapper"}),
        ('<StackPanel Orientation="Horizontal"><StackPanel><A/><B/></StackPanel></StackPanel>', {"single-child-wrapper-container"}),
        ("<Grid><Grid.Rows/><Grid><A/><B/></Grid></Grid>", {"single-child-wrapper-container"}),
        ('<T Text="{Binding Name}"/>', {"missing-typed-binding-context"}),
        ('<T x:DataType="v" Text="{Binding Name}"/><T Text="{Binding A, ElementName=b}"/>', set()),
    ],
)
def test_markup(spark, body, rules):
    from changeloom.operators import rules_markup, rules_text

    r = scan(spark, [("M", "v.axaml", MARKUP.format(body))], per_file=[*rules_markup.PER_FILE, rules_text.untyped_bindings], several_files=[])
    assert {x.rule_id for x in r.findings.collect()} == rules


BLOCK = "".join(f"    var v{i} = Call({i});\n" for i in range(7))


def test_duplicates(spark):
    new, old = ("A", "n.cs", f"class N {{\n// c\n{BLOCK}}}\n"), ("class O {\n\n  /* x\n */" + BLOCK.replace("  ", "\t") + "}\n")
    repo = spark.createDataFrame([("o.cs", old), ("n.cs", "gone")], "path string, text string")
    r = scan(spark, [new], repository=repo)
    assert found(r, "duplicate-code-block") == [("n.cs", 3, "Suggestion")]
    assert "7 line(s) of `o.cs:4`" in r.findings.where("rule_id = 'duplicate-code-block'").first().message
    assert found(scan(spark, [new], repository=repo, is_entire_repository_scan=True), "duplicate-code-block") == []
    assert found(scan(spark, [("A", "n.cs", "".join(BLOCK.splitlines(True)[:5]))], repository=repo), "duplicate-code-block") == []
    inside = ("M", "s.cs", "class S {\n" + BLOCK + "}\n" + BLOCK, [10, 11, 12, 13, 14, 15, 16])
    assert found(scan(spark, [inside]), "duplicate-code-block") == [("s.cs", 10, "Suggestion")]


def test_empty_and_null_change_sets(spark):
    assert found(scan(spark, [])) == []
    r = scan(spark, [(None, None, None), ("M", "a.cs", None), ("A", "b.axaml", ""), ("A", "c.resx", "")])
    assert found(r) == [] and r.info.count() == 0


def test_catalog(spark):
    assert len(model.CATEGORY) == 64 and model.FIXABLE < set(model.CATEGORY) and len(model.FIXABLE) == 14
    c = spark.createDataFrame([("empty-catch",), ("nope",), (None,)], "r string").select(model.category(F.col("r"))).collect()
    assert [x[0] for x in c] == ["Correctness", "Maintainability", "Maintainability"]


def test_rescan_replaces_a_files_findings(spark):
    files = spark.createDataFrame([("", "A", "a.cs", "class A { void M() { Thread.Sleep(1); } }"), ("", "A", "b.cs", "class B { void M() { Thread.Sleep(1); } }")], "repo_id string, status string, path string, text string")
    before = engine.review(files).findings
    after = engine.rescan(before, files.withColumn("text", F.lit("class A { }")), files.where("path = 'a.cs'").select("repo_id", "path"))
    assert {r.file_path for r in after.where("rule_id = 'thread-sleep'").collect()} == {"b.cs"}


def test_rules_are_passed_in(spark):
    from changeloom.operators import rules_text
    from changeloom.operators.scope import finding, one

    def long_path():
        return one(F.length("path") > 3, finding("long-path", "Hint", F.lit(1), F.lit("Long.")))

    def broken():
        raise ValueError("no")

    seen = []
    rows = [("M", "abc/d.cs", "class A { void M() { Thread.Sleep(1); } }")]
    r = scan(spark, rows, per_file=[long_path, broken], several_files=[], progress=lambda n, of, name: seen.append((n, of, name)))
    assert [x.rule_id for x in r.findings.collect()] == ["long-path"] and seen == [(1, 2, "long_path"), (2, 2, "broken")]
    assert "broken" in r.info.first().message
    r = scan(spark, rows, progress=lambda n, of, name: n < 2)
    assert r.info.count() == 0 and found(r) == []
    r = scan(spark, rows)
    assert r.info.count() == 0 and found(r, "thread-sleep") == [("abc/d.cs", 1, "Suggestion")]
    assert rules_text.empty_catch in engine.PER_FILE
    plan = r.findings._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan  # the facts are read from the table that the one pass wrote


def test_a_file_that_does_not_parse_keeps_its_suppressions(spark):
    assert [c["rule_id"] for c in csharp.candidates("#pragma warning disable CS1\nclass A {")] == ["warning-suppression"]


def test_far_suppression_in_an_attribute_list():
    long = ", ".join(f'"{i}"' for i in range(60))
    assert [c["rule_id"] for c in csharp.candidates(f"[A({long}), SuppressMessage(\"a\", \"b\")]\nclass C {{ }}")] == ["warning-suppression"]

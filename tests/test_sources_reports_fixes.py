"""Sources against real git, diff parsing, reports, fixes and incremental reviews."""

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeloom.functions import paths as P
from changeloom.functions import text as X
from changeloom.operators import fixes, report
from changeloom.sources import diffs, git
from changeloom.sources import pull_requests as pr


def one(spark, expr, *values):
    names = "abc"[: len(values)]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(expr.alias("x")).first()["x"]


@pytest.fixture
def repo(tmp_path):
    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)

    def write(p, t):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)

    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@example.com")
    run("config", "user.name", "n")
    write("src/A.cs", "class A\n{\n    int x;\n}\n")
    write("src/B b.cs", "class B {}\n")
    write("src/Gone.cs", "class G {}\n")
    run("add", ".")
    run("commit", "-qm", "1")
    run("checkout", "-qb", "f")
    write("src/A.cs", "class A\n{\n    int x;\n    int y;\n++q;\n}\n")
    write("src/C.cs", "class C {}\nclass D {}\n")
    run("rm", "-q", "src/Gone.cs")
    run("add", ".")
    run("commit", "-qm", "2")
    write("src/New+1.cs", "class E {}\n")
    write("src/B b.cs", "class B { }\n//x\n")
    write("bin/x.cs", "class X {}\n")
    return str(tmp_path)


def rows(result):
    return {(r.status, r.path, tuple(r.added_lines)) for r in result.files.collect()}


def test_git_sources(spark, repo):
    assert rows(git.working_tree(spark, repo)) == {("M", "src/B b.cs", (1, 2)), ("A", "src/New+1.cs", (1, 2))}
    assert rows(git.branch(spark, repo, "main")) == {("M", "src/A.cs", (4, 5)), ("A", "src/C.cs", (1, 2)), ("M", "src/B b.cs", (1, 2)), ("A", "src/New+1.cs", (1, 2))}
    assert rows(git.commit(spark, repo, "HEAD")) == {("M", "src/A.cs", (4, 5)), ("A", "src/C.cs", (1, 2))}
    r = git.repository(spark, repo)
    assert r.is_entire_repository_scan and {(s, p) for s, p, _ in rows(r)} == {("M", p) for p in ("src/A.cs", "src/B b.cs", "src/C.cs", "src/New+1.cs")}
    assert {x.path for x in git.folder(spark, repo).collect()} == {"src/A.cs", "src/B b.cs", "src/C.cs", "src/New+1.cs"}
    tips = {tuple(x.branches) for x in git.branch_tips(spark, repo).collect()}
    assert tips == {("f",), ("main",)}


def test_diff_parsing(spark):
    raw = "@@ -0,0 +3,2 @@\n+++x;\n+b\n@@ -9 +12 @@ void M()\n-a\n+c\n\\ No newline at end of file"
    assert one(spark, diffs.added_lines(F.col("a")), raw) == [3, 4, 12]
    assert one(spark, diffs.added_lines(F.col("a"), True), raw) == [3, 12]
    assert one(spark, diffs.added_lines(F.col("a")), "") == []
    listed = one(spark, diffs.name_status(F.col("a")), "M\ta.cs\r\n\nR100\told.cs\tnew\\x.cs\nbad\nA\t\n")
    assert [(x.status, x.path) for x in listed] == [("M", "a.cs"), ("R", "new/x.cs")]
    a = spark.createDataFrame([("", "A", "x.cs")], "repo_id string, status string, path string")
    b = spark.createDataFrame([("", "M", "X.cs"), ("", "M", "y.cs")], "repo_id string, status string, path string")
    assert {tuple(x) for x in diffs.merge(a, b).select("status", "path").collect()} == {("A", "x.cs"), ("M", "y.cs")}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \t é", max_size=5), min_size=1, max_size=6), st.sampled_from(["\n", "\r\n", "\r"]))
def test_lines_split_on_line_ends_only(spark, parts, end):
    assert one(spark, X.lines(F.col("a")), end.join(parts)) == parts


@pytest.mark.parametrize(
    "f, path, want",
    [
        (P.is_ignored, "src/obj/x.cs", True), (P.is_ignored, "a.g.cs", True), (P.is_ignored, "src/objects/x.cs", False), (P.is_ignored, "bin\\a.cs", True),
        (P.is_test, "FooTests.cs", True), (P.is_test, "a/Tests/x.cs", True), (P.is_test, "Tests/x.cs", False), (P.is_test, "a\\UnitTests\\x.cs", True),
        (P.is_interface, "a/IFoo.cs", True), (P.is_interface, "a/Item.cs", False), (P.is_code, "a.CSPROJ", True), (P.is_resx, "a.resx", True), (P.is_resx, None, False),
        (P.is_source, "x.py", True), (P.is_source, "x.txt", False), (P.is_markup, "v.xaml", True), (P.is_code_behind, "v.axaml.cs", True), (P.is_analyzable, "", False),
    ],
)
def test_paths(spark, f, path, want):
    assert one(spark, f(F.col("a")), path) is want


def test_text_functions(spark):
    assert one(spark, X.branch_name(F.col("a")), " refs/remotes/origin/feature/x ") == "feature/x"
    assert one(spark, X.branch_name(F.col("a")), "origin") is None
    assert one(spark, X.quote_names(F.col("a")), "it 'x' y") == "it `x` y"
    assert one(spark, X.word_count(F.col("a"), "color"), "Color colors color1 discolor color") == 3
    assert tuple(one(spark, X.log_location(F.col("a")), "PASS [src/a.cs:12] x")) == ("src/a.cs", 12)


def test_pull_requests(spark):
    ref = one(spark, pr.reference(F.col("a")), "https://h.example.com/ctx/projects/AB/repos/my-r/pull-requests/12/overview?x=1")
    assert tuple(ref) == ("https://h.example.com/ctx", "AB", "my-r", 12)
    for u in ("ssh://git@h.example.com:7999/AB/my-r.git", "https://h.example.com/scm/ab/my-r.git", "git@h.example.com:ab/my-r"):
        assert tuple(one(spark, pr.remote_identity(F.col("a")), u)) == ("ab", "my-r")
    m = one(spark, pr.metadata(F.col("a")), '{"state":"open","title":"t","author":{"user":{"name":"n"}},"toRef":{"id":"refs/heads/main"}}')
    assert tuple(m) == ("OPEN", "t", "n", "main")
    pages = {0: '{"values":[{"path":{"toString":"a/B.cs"}},{"path":{"components":["a","c.cs"]}}],"isLastPage":false,"nextPageStart":2}', 2: '{"values":[{"path":{"toString":"A/b.cs"}}],"isLastPage":true}'}
    got = {x.path.lower() for x in pr.changed_paths(pr.fetch_pages(spark, pages.__getitem__)).collect()}
    assert got == {"a/b.cs", "a/c.cs"}
    assert pr.merge_commit('{"properties":{"mergeCommit":{"id":"abcdef1"}}}', None) == "abcdef1"
    assert pr.merge_commit("{}", '{"values":[{"action":"OPENED"},{"action":"MERGED","commit":{"id":"1234567"}}]}') == "1234567"
    assert pr.merge_commit("no json", None) is None
    c = spark.createDataFrame([("", "a/b/x.cs"), ("", "a/b/c/y.cs"), ("", "z.cs")], "repo_id string, path string")
    s = spark.createDataFrame([("", "a/b/One.sln"), ("", "Two.sln")], "repo_id string, path string")
    assert pr.closest_solution(c, s).first().path == "a/b/One.sln"


FINDINGS = "repo_id string, severity string, severity_rank int, rule_id string, file_path string, line_number int, message string"


def test_reports(spark):
    f = spark.createDataFrame([("", "Hint", 1, "thread-sleep", "b.cs", 3, "m1"), ("", "Hint", 1, "empty-catch", "B.cs", None, "m2"), ("", "Ok", 0, "empty-catch", "c.cs", 1, "no"), ("", "Hint", 1, "async-void", " ", 0, "m3")], FINDINGS)
    c = report.categorised(f).cache()
    assert [(r.category, r.n) for r in report.category_counts(c).collect()] == [("Threading", 2), ("Correctness", 1)]
    assert tuple(report.summary(c, report.visible(c, ["threading"])).first()) == (2, 1, 1, True)
    assert [r.message for r in report.ordered(c).collect()] == ["m2", "m3", "m1"]
    out = [r.line for r in report.export(report.include_rule(c, "ASYNC-VOID", False)).orderBy("position").collect()]
    assert out[0].endswith("Count: 2\n") and out[1].startswith("1. [Correctness] B.cs") and out[2].startswith("2. [Threading] b.cs:3")
    assert report.toggle_all(c).where("is_included").count() == 0
    assert report.toggle_all(report.toggle_all(c)).where("is_included").count() == 3
    assert report.nearest(c, "B.CS", 9).first().message == "m1"
    files = spark.createDataFrame([("", "b.cs", list("vwxyz"))], "repo_id string, path string, lines array<string>")
    assert report.with_preview(c.where("message = 'm1'"), files, 1).first().preview == "  2 | w\n> 3 | x\n  4 | y"
    assert report.export(c.where("false")).count() == 0
    n = report.numbered(spark.range(1000).withColumn("v", F.col("id") % 7), ["v", "id"], "p").orderBy("p").collect()
    assert [r.p for r in n] == list(range(1, 1001)) and [(r.v, r.id) for r in n] == sorted((r.v, r.id) for r in n)


FIXES = [
    ("throw-ex-in-catch", "a\n  throw ex;\n", 2, "", "a\n  throw;\n"),
    ("unnecessary-verbatim-string-prefix", 'var a = @"x";\n', 1, "", 'var a = "x";\n'),
    ("unnecessary-enum-member-value", "enum E {\n A = 0,\n B\n}\n", 2, "", "enum E {\n A,\n B\n}\n"),
    ("redundant-self-lookup", "var f = Foo.GetFoo(this);", 1, "", "var f = this;"),
    ("method-can-be-static", "class A {\n private int M() { return 1; }\n}\n", 2, "", "class A {\n private static int M() { return 1; }\n}\n"),
    ("local-variable-can-be-const", 'class A { void M() {\n var s = "a"; Go(s);\n} }', 2, "Local variable 's' can be const.", 'class A { void M() {\n const string s = "a"; Go(s);\n} }'),
    ("lambda-can-be-method-group", "x.ForEach(i => Go(i));", 1, "can be 'Go'.", "x.ForEach(Go);"),
    ("unused-private-member", "class A {\n\n /// d\n private void M()\n {\n }\n\n int x;\n}\n", 4, "Private method 'M' is never used.", "class A {\n\n int x;\n}\n"),
    ("unused-private-member", "class A {\n private int x;\n}\n", 2, "Private field 'x' is never used.", None),
    ("warning-suppression", "#pragma warning disable X\nclass A { }\n", 1, "", "class A { }\n"),
    ("unused-usings-roslyn", "using A;\nglobal using B;\n", 1, "", "global using B;\n"),
    ("unused-usings-roslyn", "using A;\nglobal using B;\n", 2, "", None),
    ("blank-line-between-brace-pairs", "{\n\n\n{\n", 4, "", "{\n{\n"),
    ("missing-blank-line-between-methods", "a\r\nb\r\n", 2, "", "a\r\n\r\nb\r\n"),
    ("if-else-unnecessary-braces", "class A { void M() {\n    if (a)\n    {\n        B();\n    }\n    else\n    {\n        C();\n    }\n} }", 2, "", "class A { void M() {\n    if (a)\n        B();\n    else\n        C();\n} }"),
    ("if-else-brace-consistency", "class A { void M() {\n    if (a)\n        B();\n    else\n    {\n        C();\n        D();\n    }\n} }", 2, "", "class A { void M() {\n    if (a)\n    {\n        B();\n    }\n    else\n    {\n        C();\n        D();\n    }\n} }"),
    ("if-else-brace-consistency", "class A { void M() {\n    if (a)\n    {\n        B();\n    }\n    else\n        C();\n} }", 2, "", "class A { void M() {\n    if (a)\n        B();\n    else\n        C();\n} }"),
    ("empty-catch", "x", 1, "", None),
    ("throw-ex-in-catch", "x", 9, "", None),
]


@pytest.mark.parametrize("rule, before, line, message, after", FIXES)
def test_fixes(rule, before, line, message, after):
    assert fixes.fix_text(rule, before, line, message)[0] == after


def test_one_fix_for_each_file(spark):
    f = spark.createDataFrame([("", "Hint", 1, "throw-ex-in-catch", "a.cs", 1, ""), ("", "Hint", 1, "throw-ex-in-catch", "a.cs", 2, ""), ("", "Hint", 1, "throw-ex-in-catch", "gone.cs", 2, ""), ("", "Hint", 1, "empty-catch", "a.cs", 2, "")], FINDINGS)
    files = spark.createDataFrame([("", "a.cs", "throw e;\nthrow f;\n")], "repo_id string, path string, text string")
    got = {r.path: (r.new_text, r.fixed) for r in fixes.fixed_files(f, files).collect()}
    assert got == {"a.cs": ("throw e;\nthrow;\n", True), "gone.cs": (None, False)}


def test_review_stream(spark, tmp_path):
    from changeloom.streaming import incremental

    def put(text):
        df = spark.createDataFrame([("", "A", "a.cs", "a.cs", text, text.split("\n"), [1])], "repo_id string, status string, path string, full_path string, text string, lines array<string>, added_lines array<int>")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        incremental.review_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    put("class A { void M() { Thread.Sleep(1); } }")
    put("class A { public async void M() { } }")
    rules = {r.rule_id for r in incremental.latest(spark.read.parquet(f"{tmp_path}/out/findings"), spark.read.parquet(f"{tmp_path}/out/files")).collect()}
    assert "async-void" in rules and "thread-sleep" not in rules
    put("/// <summary>Fine.</summary>\nclass A { }")
    assert incremental.latest(spark.read.parquet(f"{tmp_path}/out/findings"), spark.read.parquet(f"{tmp_path}/out/files")).count() == 0

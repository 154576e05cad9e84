"""The engine's own operators over rows made from the benchmark tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom import model
from changeloom.functions import paths as P
from changeloom.functions import text as X
from changeloom.operators import duplicates, report, scope
from changeloom.sources import diffs, pull_requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = sorted(model.CATEGORY)
_LIST = "[" + ", ".join(f"'{r}'" for r in RULES) + "]"
_CATEGORY = "[" + ", ".join(f"'{model.CATEGORY[r]}'" for r in RULES) + "]"
_NAMES = "[" + ", ".join(f"'{c}'" for c in model.CATEGORIES) + "]"
_COLOURS = "[" + ", ".join(f"'{c}'" for c in model.COLOURS) + "]"
#: Findings of the events: every 65th has a rule that isn't in the catalogue, every 7th no file, every 5th no line.
FINDINGS = f"""SELECT event_id, CASE WHEN event_id % 65 = 64 THEN 'other' ELSE {_LIST}[event_id % 65 + 1] END AS rule_id, CASE WHEN event_id % 65 = 64 THEN 'Maintainability' ELSE {_CATEGORY}[event_id % 65 + 1] END AS category,
['Ok', 'Hint', 'Suggestion', 'Important'][event_id % 4 + 1] AS severity, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'src/F' || (user_id % 40) || '.cs' ELSE 'SRC/f' || (user_id % 40) || '.cs' END AS file_path,
CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(event_id % 90 AS INTEGER) END AS line_number, 'about ' || event_id AS message, event_id % 3 <> 0 AS is_included FROM events"""
ROWS = f"SELECT *, list_position({_NAMES}, category) - 1 AS category_rank, CASE WHEN file_path = '' THEN '(no file)' WHEN line_number > 0 THEN file_path || ':' || line_number ELSE file_path END AS location FROM ({FINDINGS}) WHERE severity <> 'Ok'"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _t(spark, sf_dir, "events"), F.col("event_id")
    rules = F.array(*map(F.lit, [*RULES, "other"]))
    return e.select(
        "event_id", F.get(rules, (i % 65).cast("int")).alias("rule_id"), F.get(F.array(*map(F.lit, model.SEVERITIES)), (i % 4).cast("int")).alias("severity"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.when(i % 2 == 0, "src/F").otherwise("SRC/f"), (F.col("user_id") % 40).cast("string"), F.lit(".cs"))).alias("file_path"),
        F.when(i % 5 == 0, 0).otherwise((i % 90).cast("int")).alias("line_number"), F.concat(F.lit("about "), i.cast("string")).alias("message"), (i % 3 != 0).alias("is_included"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.categorised(findings(spark, sf_dir))


@query(f"SELECT event_id, category, CAST(category_rank AS INTEGER) AS category_rank, location FROM ({ROWS})")
def report_categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", "category", "category_rank", "location")


@query(f"SELECT category, count(*) AS n, round(count(*) * 360.0 / sum(count(*)) OVER (), 6) AS share, {_COLOURS}[any_value(category_rank) + 1] AS colour FROM ({ROWS}) GROUP BY category")
def report_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_counts(rows(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"SELECT r.rule_id, count(event_id) AS n FROM (SELECT unnest({_LIST}) AS rule_id) r LEFT JOIN ({FINDINGS}) f ON f.rule_id = r.rule_id WHERE r.rule_id <> 'thread-sleep' GROUP BY r.rule_id")
def report_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the catalogue but one that failed."""
    failed = spark.createDataFrame([("thread-sleep",)], "rule_id string")
    return report.rule_counts(findings(spark, sf_dir), model.rule_catalog(spark), failed)


_SHOWN = f"SELECT * FROM ({ROWS}) WHERE lower(category) IN ('ui', 'testing', 'readability')"


@query(f"SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN file_path <> '' THEN upper(file_path) END) AS n_files, (SELECT count(*) FROM ({ROWS})) - count(*) AS hidden, bool_or(is_included) AS any_included, count(*) || ' finding(s) across ' || count(DISTINCT CASE WHEN file_path <> '' THEN upper(file_path) END) || ' file(s) (' || ((SELECT count(*) FROM ({ROWS})) - count(*)) || ' hidden)' AS text FROM ({_SHOWN})")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible findings, their files in any case, and how many the filter hides."""
    every = rows(spark, sf_dir)
    return report.summary_text(report.summary(every, report.visible(every, ["UI", "testing", "Readability"])))


@query(f"SELECT event_id, is_included AND rule_id <> 'async-void' AS is_included FROM ({ROWS})")
def report_include_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.include_rule(rows(spark, sf_dir), "ASYNC-Void", False).select("event_id", "is_included")


@query(f"SELECT event_id, (SELECT count(*) FILTER (WHERE is_included) <= count(*) FILTER (WHERE NOT is_included) FROM ({_SHOWN})) AS is_included FROM ({_SHOWN})")
def report_toggle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.toggle_all(report.visible(rows(spark, sf_dir), ["ui", "testing", "readability"])).select("event_id", "is_included")


@query(f"SELECT abs(line_number - 41) AS away, line_number FROM ({ROWS}) WHERE upper(file_path) = 'SRC/F7.CS' ORDER BY abs(line_number - 41), line_number LIMIT 1")
def report_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nearest(rows(spark, sf_dir), "src/f7.cs", 41).select(F.abs(F.col("line_number") - 41).alias("away"), "line_number")


@query(f"SELECT 0::BIGINT AS position, 'Findings' || chr(10) || 'Scope: included' || chr(10) || 'Count: ' || count(*) || chr(10) AS line FROM ({ROWS}) WHERE is_included UNION ALL SELECT position, position || '. [' || category || '] ' || location || chr(10) || '   ' || message || chr(10) FROM (SELECT *, row_number() OVER (ORDER BY category_rank, upper(rule_id), upper(file_path), line_number, message) AS position FROM ({ROWS}) WHERE is_included)")
def report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.export(rows(spark, sf_dir))


@query("SELECT doc_id, 'Please fix this finding in d' || doc_id || ':1:' || chr(10) || 'm' || chr(10) || chr(10) || '> 1 | ' || ls[1] || CASE WHEN len(ls) > 1 THEN chr(10) || '  2 | ' || ls[2] ELSE '' END AS prompt FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 0)")
def report_fix_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding in the first line of every tenth document, with the lines around it."""
    docs = _t(spark, sf_dir, "documents").where("text is not null and doc_id % 10 = 0").select("doc_id", F.lit("").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.split("text", "\n", -1).alias("lines"))
    found = docs.select("doc_id", "repo_id", F.col("path").alias("file_path"), F.lit("async-void").alias("rule_id"), F.lit("Hint").alias("severity"), F.lit(1).alias("line_number"), F.lit("m").alias("message"))
    return report.fix_prompt(report.with_preview(report.categorised(found), docs, 1)).select("doc_id", "prompt")


@query(f"SELECT event_id, is_included AND event_id % 2 = 0 AS open_active, is_included AND event_id % 4 < 3 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS comment_active, is_included AND event_id % 17 <> 0 AS fix_active, FALSE AS prompt_active FROM ({FINDINGS})")
def report_row_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.row_actions(_flagged(spark, sf_dir)).select("event_id", "open_active", "comment_active", "fix_active", "prompt_active")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return findings(spark, sf_dir).withColumns({"can_open": i % 2 == 0, "can_comment": i % 4 < 3, "can_fix": F.lit(True), "is_posting": i % 11 == 0, "has_posted": F.when(i % 13 == 0, True), "has_been_fixed": i % 17 == 0})


@query(f"SELECT count(*) > 0 AS can_toggle, bool_or(is_included) AS can_export, bool_or(is_included AND event_id % 4 < 3 AND event_id % 11 <> 0 AND event_id % 13 <> 0) AS can_comment FROM ({FINDINGS})")
def report_batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.batch_state(report.row_actions(_flagged(spark, sf_dir)))


_SAID = ", ".join(f"('{r}', '{t.replace(chr(39), chr(39) * 2)}')" for r, t in report.COMMENTS.items())


@query(f"SELECT event_id, coalesce(t, message) AS comment FROM ({FINDINGS}) LEFT JOIN (VALUES {_SAID}) v(r, t) ON r = rule_id")
def report_comment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("event_id", report.comment_text(F.col("rule_id"), F.col("message")).alias("comment"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'pass' WHEN 2 THEN 'warning' WHEN 3 THEN 'hint' WHEN 4 THEN 'error' ELSE 'info' END AS colour FROM events")
def log_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, ["[Error] a", "check: Pass", "a warning, a hint", "Hint: b", "passed with errors", "nothing"]))
    return _t(spark, sf_dir, "events").select("event_id", report.log_colour(F.get(texts, (F.col("event_id") % 6).cast("int"))).alias("colour"))


def _key(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    return _t(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")


@query("SELECT s_suppkey, status, path FROM supplier, LATERAL (SELECT * FROM (VALUES ('M', 'src/a' || s_suppkey || '.cs'), ('R', 'new' || s_suppkey || '.cs'), ('A', 'x/b.cs'), ('D', 'gone.cs')) v(status, path))")
def diff_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = _key(spark, sf_dir)
    raw = F.concat(F.lit("M\tsrc\\a"), k, F.lit(".cs\nR100\told.cs\tnew"), k, F.lit(".cs\r\n\n  \nX\na\tx/b.cs\nD\tgone.cs\n"))
    return s.select("s_suppkey", F.explode(diffs.name_status(raw)).alias("e")).select("s_suppkey", "e.status", "e.path")


@query("SELECT s_suppkey, unnest([s_suppkey + 1, s_suppkey + 2, s_suppkey + 4, 2000 + s_suppkey])::INTEGER AS line FROM supplier")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that starts with ++ counts, context and removed lines don't."""
    s, k = _key(spark, sf_dir)
    raw = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,2 +"), (F.col("s_suppkey") + 1).cast("string"), F.lit(",4 @@\n+a\n+++b;\n-c\n d\n+e\n\\ No newline\n@@ -9 +"), (F.col("s_suppkey") + 2000).cast("string"), F.lit(" @@\n-f\n+g\n"))
    return s.select("s_suppkey", F.explode(diffs.added_lines(raw)).alias("line"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS repo_id, CASE WHEN s_suppkey % 2 = 0 THEN 'SRC/F' || s_suppkey || '.cs' ELSE 'src/f' || s_suppkey || '.cs' END AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'base' ELSE 'more' END AS origin FROM supplier")
def diff_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base's entry wins, whatever the case of its path."""
    s, k = _key(spark, sf_dir)
    of = lambda a, origin: s.select("s_suppkey", F.col("s_nationkey").cast("string").alias("repo_id"), F.concat(F.lit(a), k, F.lit(".cs")).alias("path"), F.lit(origin).alias("origin"))
    return diffs.merge(of("SRC/F", "base").where("s_suppkey % 2 = 0"), of("src/f", "more")).drop("s_suppkey")


@query("SELECT repo_id, min(event_id) AS event_id FROM (SELECT event_type AS repo_id, user_id % 40 AS f, event_id FROM events) GROUP BY repo_id, f")
def diff_first_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the files of a repository whose paths differ only in case."""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("repo_id"), F.concat(F.when(F.col("event_id") % 2 == 0, "src/A").otherwise("SRC/a"), (F.col("user_id") % 40).cast("string")).alias("path"), "event_id")
    return diffs.first_by_path(e, "event_id").select("repo_id", "event_id")


@query("SELECT repo_id, path FROM (SELECT CAST(c_nationkey AS VARCHAR) AS repo_id, c_mktsegment || '/app/' || c_mktsegment || '.sln' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE n = 1")
def nearest_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are changed files in a folder for their segment, which has a solution file, beside one at the root that is always further away."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("repo_id"), "c_mktsegment", F.concat("c_mktsegment", F.lit("/app/src/C"), F.col("c_custkey").cast("string"), F.lit(".cs")).alias("path"))
    sln = c.select("repo_id", F.concat("c_mktsegment", F.lit("/app/"), "c_mktsegment", F.lit(".sln")).alias("path")).distinct()
    root = c.select("repo_id", F.lit("All.sln").alias("path")).distinct()
    return pull_requests.closest_solution(c.select("repo_id", "path"), sln.unionByName(root))


#: path, and what it is: generated, ignored, code, resx, duplicate-checked, analysed, test, source, code-behind, markup, interface.
PATHS = [
    ("src/A.cs", "..c.da.s..."), ("src/A.g.cs", "gi........."), ("src/bin/A.cs", ".i........."), ("x/obj/Debug/B.cs", ".i........."), ("src/A.Designer.cs", "gi........."), ("src/S.resx", "...r.a....."), ("ui/V.axaml", "..c.da...m."),
    ("ui/V.xaml.cs", "..c.da.sb.."), ("src/IThing.cs", "..c.da.s..I"), ("src/Item.cs", "..c.da.s..."), ("test/FooTests.cs", "..c.dats..."), ("UnitTests/Foo.cs", "..c.dats..."), ("src/P.csproj", "..c..a....."), ("README.md", "..........."), ("src/a.py", ".......s..."), ("SRC/B.CS", "..c.da.s..."),
]
_KINDS = (P.is_generated, P.is_ignored, P.is_code, P.is_resx, P.is_duplicate_checked, P.is_analyzable, P.is_test, P.is_source, P.is_code_behind, P.is_markup, P.is_interface)
_VALUES = ", ".join(f"('{p}', '{k}')" for p, k in PATHS)


@query(f"SELECT CAST(s_suppkey AS VARCHAR) || '/' || p AS path, k AS kinds FROM supplier, (VALUES {_VALUES}) v(p, k)")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter for each kind of path."""
    s, k = _key(spark, sf_dir)
    paths = s.select(F.explode(F.array(*(F.concat(k, F.lit(f"/{p}")) for p, _ in PATHS))).alias("path"))
    return paths.select("path", F.concat(*(F.when(f(F.col("path")), c).otherwise(".") for f, c in zip(_KINDS, "gicrdatsbmI", strict=True))).alias("kinds"))


@query("WITH l AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, list(l_linenumber) FILTER (WHERE l_quantity > 40) AS added FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, l_orderkey % 5 = 0 OR coalesce(len(list_filter(added, lambda x: x BETWEEN 2 AND 3)) > 0, FALSE) AS touched, l_orderkey % 5 = 0 OR coalesce(list_contains(added, 2), FALSE) AS is_new FROM l")
def scope_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file, its large items are the added lines; every fifth file is new."""
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 40, F.col("l_linenumber").cast("int"))).alias("added_lines"))
    files = o.select(F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_orderkey") % 5 == 0, "a").otherwise("M").alias("status"), F.lit("a\nb\nc").alias("text"), "added_lines")
    ready = scope.with_scope(scope.prepare(files), False)
    return ready.select(F.col("path").cast("long").alias("l_orderkey"), scope.touches(F.lit(2), F.lit(3)).alias("touched"), scope.is_new(F.lit(2)).alias("is_new"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'topic/' || s_suppkey WHEN 1 THEN 'main' ELSE NULL END AS branch, 'src/F' || s_suppkey || '.cs' AS path, CAST(s_suppkey AS INTEGER) AS line, 'Type `F' || s_suppkey || '` is odd' AS quoted, 'a(); ' || chr(10) || 'b();' AS code FROM supplier")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch names, places in log lines, quoted names, code without comments."""
    s, k = _key(spark, sf_dir)
    ref = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit(" refs/remotes/origin/topic/"), k)).when(F.col("s_suppkey") % 4 == 1, "refs/heads/main").when(F.col("s_suppkey") % 4 == 2, "origin/HEAD").otherwise("  ")
    at = X.log_location(F.concat(F.lit("Hint [src/F"), k, F.lit(".cs:"), k, F.lit("] text")))
    return s.select("s_suppkey", X.branch_name(ref).alias("branch"), at["path"].alias("path"), at["line"].alias("line"), X.quote_names(F.concat(F.lit("Type 'F"), k, F.lit("' is odd"))).alias("quoted"), X.strip_comments(F.concat(F.lit("a(); // say "), k, F.lit("\n/* two\nlines */b();"))).alias("code"))


@query("SELECT a.s_suppkey AS a, CAST(i AS INTEGER) AS idx, CAST(i + 1 AS INTEGER) AS first FROM supplier a, (SELECT unnest(range(0, 4)) AS i) WHERE a.s_suppkey % 2 = 0")
def code_windows_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six counted lines: comments, braces and short lines don't count, and an odd supplier's file has too few lines."""
    s, k = _key(spark, sf_dir)
    lines = [F.concat(F.lit(f"var x{i} = Call("), k, F.lit(");")) for i in range(9)]
    text = F.array_join(F.array(*lines, F.lit("}"), F.lit("// c"), F.lit("")), "\n")
    files = s.select(k.alias("repo_id"), F.lit("A").alias("status"), F.lit("src/F.cs").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, text).otherwise("a();\nb();").alias("text"))
    w = duplicates.code_windows(scope.with_scope(scope.prepare(files), True), True, 6)
    return w.select(F.col("repo_id").cast("long").alias("a"), F.col("idx").cast("int").alias("idx"), F.col("first").cast("int").alias("first"))

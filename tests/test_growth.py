"""No operator of a plan makes many more rows than it was given."""

from pyspark.sql import functions as F

from changeloom.operators.duplicates import equal_windows, first_elsewhere
from changeloom.plans import carriers
from changeloom.sources import pull_requests as pr


def most_rows(df) -> tuple[list, int]:
    """The rows, and the most that any operator put out."""
    rows = df.collect()

    def walk(p) -> int:
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().get("numOutputRows")
        kids = p.children()
        return max([own.get().value() if own.isDefined() else 0, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_solution_is_looked_up_for_folders(spark):
    """300 paths in two folders are four folders up; each path was exploded to its five."""
    deep = spark.range(300).select(F.lit("r").alias("repo_id"), F.concat(F.when(F.col("id") < 200, "a/b/c/d/x").otherwise("a/q/c/d/x"), F.col("id").cast("string"), F.lit(".cs")).alias("path"))
    s = spark.createDataFrame([("r", "a/b/One.sln"), ("r", "a/b/Two.sln"), ("r", "Top.sln")], "repo_id string, path string")
    rows, most = most_rows(pr.closest_solution(deep, s))
    assert [tuple(r) for r in rows] == [("r", "a/b/One.sln")]
    assert most <= 300


def test_closest_solution_votes(spark):
    """Repeated paths vote once, odd slashes, spaces and nulls go where they went, ties go to the deeper one, a repository without a solution has no row."""
    c = spark.createDataFrame(
        [("r", "x/a.cs"), ("r", "x/a.cs"), ("r", "x/a.cs"), ("r", "y/a.cs"), ("r", " y\\b.cs "), ("t", "a/b/c.cs"), ("t", "z.cs"), ("n", "a/b.cs"), ("e", ""), ("e", None), (None, "x/a.cs"), ("d", "p//q/r.cs"), ("d", "/top.cs"), ("d", "p//q.cs")],
        "repo_id string, path string",
    )
    s = spark.createDataFrame([("r", "x/X.sln"), ("r", "y/Y.sln"), ("r", "y/Y.sln"), ("t", "a/A.sln"), ("t", "T.sln"), ("e", "E.sln"), ("d", "p//P.sln"), ("d", "D.sln"), (None, "x/X.sln")], "repo_id string, path string")
    got = {r.repo_id: r.path for r in pr.closest_solution(c, s).collect()}
    assert got == {"r": "y/Y.sln", "t": "a/A.sln", "e": "E.sln", "d": "p//P.sln"}


def test_first_match_makes_no_pairs(spark, tmp_path):
    """80 copies of a block: each has one first match, where the pairs are 6320."""
    spark.range(80).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd\ne\nf").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows, most = most_rows(carriers.dup_first_match(spark, str(tmp_path)))
    assert {tuple(r) for r in rows} == {(d, 0, 0 if d else 1, 0) for d in range(80)}
    assert most <= 80


def test_first_match_of_odd_windows(spark):
    """Against all pairs: a block twice in a document, in one only, repeated rows, null keys, keys that are texts."""
    odd = [(3, 5, 1), (3, 2, 1), (7, 9, 1), (7, 1, 1), (7, 1, 1), (9, 0, 1), (None, 0, 1), (4, 0, 2), (4, 1, 2), (None, 3, 3), (5, 0, 3), (None, 4, 3), (-1, 8, 4), (8, 0, 4)]
    for cast in ("bigint", "string"):
        w = windows(spark, odd).withColumn("doc_id", F.col("doc_id").cast(cast))
        p = equal_windows(w).where("doc_id_a != doc_id_b").groupBy("doc_id_a", "idx_a").agg(F.min(F.struct("doc_id_b", "idx_b")).alias("m"))
        got = {(r.doc_id, r.idx, *r.m) for r in first_elsewhere(w, "doc_id").collect()}
        assert got == {(r[0], r[1], *r.m) for r in p.collect()} and len(got) == 7
    assert first_elsewhere(w.limit(0), "doc_id").count() == 0


def windows(spark, rows):
    """(doc_id, idx, h1, h2) of (doc_id, idx, text)."""
    return spark.createDataFrame(rows, "doc_id long, idx int, t int").select("doc_id", "idx", F.xxhash64("t").alias("h1"), F.xxhash64("t", F.lit(1)).alias("h2"))

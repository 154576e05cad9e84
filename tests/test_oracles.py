"""The carrier queries against their SQL twins on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from changeloom.plans import carriers, operator_cases, rule_cases

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


QUERIES = {**carriers.QUERIES, **operator_cases.QUERIES, **rule_cases.QUERIES}
SQL = {**carriers.SQL, **operator_cases.SQL, **rule_cases.SQL}


@pytest.fixture
def production(spark, request):
    """The session's defaults; the rules' big expressions stay interpreted, since each would be compiled for a few rows."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in names}
    if request.node.callspec.params["name"] not in rule_cases.QUERIES:
        for k, v in names.items():
            spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_rule_and_fix_has_a_query():
    from changeloom import model

    assert {c.rule for c in rule_cases.CASES} == set(model.CATEGORY)
    assert {c.rule for c in rule_cases.CASES if c.after is not None} == model.FIXABLE


#: The rules' cases take some seconds each: here those of the fixes, which run their rules too, and of the rules over several files.
CHOSEN = [n for n in rule_cases.QUERIES if n.startswith("fix_") or n.removeprefix("rule_").replace("_", "-") in rule_cases._SEVERAL]


@pytest.mark.parametrize("name", sorted({*carriers.QUERIES, *operator_cases.QUERIES, *CHOSEN}))
def test_same_rows(production, con, name):
    mine = QUERIES[name](production, SF)
    other = con.sql(SQL[name])
    cols = sorted(mine.columns)
    assert cols == sorted(other.columns)
    a = sorted(str([r[c] for c in cols]) for r in mine.collect())
    at = [other.columns.index(c) for c in cols]
    b = sorted(str([r[i] for i in at]) for r in other.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 184
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark):
    plan = carriers.threshold_groups(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


@pytest.mark.parametrize("adaptive, advisory", [("true", "64m"), ("true", "2m"), ("false", "64m")])
def test_numbered_positions(spark, adaptive, advisory):
    """Every row once, in order, whatever adaptive execution makes of the ranges."""
    from pyspark.sql import functions as F

    from changeloom.operators.report import numbered

    names = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        n = 300_000
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = numbered(rows, ["v"], "position").agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.count_if(F.col("position") != F.col("v") + 1).alias("wrong")).first()
        assert (got.n, got.d, got.wrong) == (n, n, 0)
        assert numbered(rows.limit(0), ["v"], "position").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

"""Folders that all executors share, for results that are written once and read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names. Local sessions that name none, as in tests, get one of their own."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    named = own.get() if own.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="changeloom-")
        sc.setCheckpointDir(named)
        named = sc._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, from a table written once: whatever reads them several times sees the same ones, and no executor's loss repeats the work."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

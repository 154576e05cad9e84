"""Helpers that the operators share: sampling under a bound, free column names, work folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FINE = 1 << 30
#: Bytes of an Arrow batch, where the session doesn't say: texts differ too much in length for a bound by rows.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> None:
    """Bounds the batches that this session sends to Python by bytes, unless it has a bound of its own."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if name not in conf.getAll:
        conf.set(name, str(BATCH))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bounded_sample(df: DataFrame, key: Column, bound: int, strata: Column | None = None) -> DataFrame:
    """About `bound` rows (for each stratum, if given), chosen by a hash of the key: the same rows on each run.

    One narrow aggregate gives the counts; the rows themselves are then filtered in place, so nothing is shuffled.
    """
    kind = F.lit("") if strata is None else strata.cast("string")
    counts = {r[0]: r[1] for r in df.groupBy(kind.alias("k")).count().collect() if r[0] is not None}
    if not counts:
        return df.where(F.lit(False))
    share = F.pmod(F.xxhash64(key, F.lit(20_231)), F.lit(_FINE))
    keep = None
    for k, n in sorted(counts.items()):
        hit = (kind == F.lit(k)) & (share < F.lit(int(min(1.0, bound / n) * _FINE)))
        keep = hit if keep is None else keep | hit
    return df.where(keep)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Tests that name none get one of their own."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="changeloom-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, materialised in the shared folder: the lineage ends here and outlives the executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

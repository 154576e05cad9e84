"""Change sets as a stream: each micro-batch of changed files is reviewed and its findings replace those of the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changeloom import model
from changeloom.plans import engine


def review_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, repository: DataFrame | None = None, **options: object) -> StreamingQuery:
    """Reviews Parquet files of changed files as they arrive in in_dir.

    out_dir/findings/batch=N has a batch's findings and out_dir/files/batch=N the files that it reviewed (repo_id, file_path), each written over if the batch runs again.
    repository: the repositories' other files, which every batch sees.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            engine.review(batch, repository, **options).findings.write.mode("overwrite").parquet(f"{out_dir}/findings/batch={number}")
            batch.select(F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.col("path").alias("file_path")).distinct().write.mode("overwrite").parquet(f"{out_dir}/files/batch={number}")
        finally:
            batch.unpersist()

    files = spark.readStream.schema(model.CHANGED_FILES).parquet(in_dir)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Of the findings of all batches, those of each file's last review; a file whose last review found nothing has none. Both tables have column batch."""
    last = files.groupBy("repo_id", "file_path").agg(F.max("batch").alias("batch"))
    return findings.join(last, ["repo_id", "file_path", "batch"], "left_semi")

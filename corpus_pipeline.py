"""Documents to training tokens: five stages, each over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changeloom.llm import decontaminate, language, neardup, quality, sentencepieces
from changeloom.llm.common import table, work_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified and isn't confidently another one than they declare.

    Null and empty texts and texts without letters go; a null declared language is accepted. Repeated rows fare alike, and all columns stay. No row: none.
    """
    return language.keep_identified(docs, language.fit(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier calls good.

    Null, empty and blank texts go, and a score of exactly 0 goes. Repeated rows fare alike, and all columns stay. No label: all texts with a token are kept.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies.

    The least doc_id stays, a null one before others; of repeated rows one stays. Null and empty texts are in no group and stay. All columns stay.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that don't hold a benchmark item.

    Null and empty texts hold none and stay, null items match nothing. Repeated rows fare alike, and all columns stay. No benchmark: all are kept.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and byte spans of each document.

    A null text has null ids and spans, an empty one empty ones. Repeated rows are encoded alike; other columns than doc_id and text go. No row: none.
    """
    return sentencepieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The stages fit models and walk sequences, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = work_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{base}/{i}_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

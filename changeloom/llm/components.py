"""Connected components of a graph of 64-bit ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import cut


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of the edges (a, b) but the roots; the root is the least id of the component.

    Each step moves every edge nearer to the least neighbour, in a number of steps logarithmic in the component's
    size; each is cut off in the shared folder. Only edges are moved, never the documents.
    """
    def mark(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while (now := mark(e)) != before:
        before = now
        both = e.union(e.select("b", "a"))
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
        small = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        e = cut(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a != b").distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))

"""Shards of balanced size by Karmarkar-Karp differencing, for groups that mustn't be divided.

A partial partition is a tuple of k sums. The two with the largest spread (largest minus least sum) are combined again and again, the
largest sum of one with the least of the other, until one is left. The CELL largest groups are differenced together. The others are hashed into cells, each
of which is differenced on its own, beginning with a partial partition of no groups: its share of the large groups' sums. So every cell evens out its
part of what the large groups left uneven, its slots are the shards, and no task holds more than a cell. A table of up to CELL groups is differenced as a whole, and
a group more than that doesn't move them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import work_dir

SHARDS, CELL = 64, 20_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions [n, k]: the k sums of the whole, and [n, k] the slot of the whole that each slot went to.

    Among equal spreads the earlier partial comes first; among equal sums the earlier slot.
    """
    n, k = sums.shape
    slot = np.empty((n, k), np.int32)
    if n == 0:
        return np.zeros(k, np.int64), slot
    state = {i: sums[i] for i in range(n)}
    heap = [(-int(s.max() - s.min()), i) for i, s in state.items()]
    heapq.heapify(heap)
    parents: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = state.pop(a), state.pop(b)
        down, up = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        new = n + len(parents)
        state[new] = x[down] + y[up]
        pa_, pb = np.empty(k, np.int32), np.empty(k, np.int32)
        pa_[down] = pb[up] = np.arange(k)
        parents.append((a, pa_, b, pb))
        heapq.heappush(heap, (-int(state[new].max() - state[new].min()), new))
    maps: dict[int, np.ndarray] = {heap[0][1]: np.arange(k, dtype=np.int32)}
    for i in range(len(parents) - 1, -1, -1):
        to = maps.pop(n + i)
        a, pa_, b, pb = parents[i]
        for c, p in ((a, pa_), (b, pb)):
            if c < n:
                slot[c] = to[p]
            else:
                maps[c] = to[p]
    if n == 1:
        slot[0] = np.arange(k)
    return state[heap[0][1]], slot


def difference_weights(weights: np.ndarray, k: int, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`difference` for single groups, each in slot 0 of its own partial: the sums, and each group's slot.

    begin: the k sums of one more partial, of no groups, whose slots are those of the result.

    Equal to it, but a partial is kept as the short list of its filled slots as long as two of them fit side by side, so n groups
    cost far less than n combinations of k slots.
    """
    n = len(weights)
    order = np.argsort(-weights, kind="stable")
    out = np.empty(n, np.int32)
    if n == 0:
        return np.zeros(k, np.int64), out
    # The k largest weights are always combined first, side by side, while every partial is one group:
    # the spread of a partial with a free slot is its largest sum, so the heap pops groups in this order.
    state = {i: ([int(weights[g])], [[int(g)]]) for i, g in enumerate(order)}
    heap = [(-s[0][0], i) for i, s in state.items()]
    new = n
    if begin is not None:  # its slots are told apart by marks
        at = np.argsort(-begin, kind="stable").tolist()
        state[n] = ([int(begin[i]) for i in at], [[~i] for i in at])
        heap.append((-int(begin.max() - begin.min()), n))
        new += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (xs, xg), (ys, yg) = state.pop(a), state.pop(b)
        # xs and ys are descending; slots that aren't listed are empty.
        free = k - len(xs)
        if len(ys) <= free:
            s, g = xs + ys, xg + yg
        else:
            # the largest of y go to the empty slots, the rest to the smallest filled ones, smallest to largest
            s, g = list(xs), list(xg)
            for i in range(len(ys)):
                at = k - 1 - i
                if at < len(xs):
                    s[at] += ys[i]
                    big, small = (g[at], yg[i]) if len(g[at]) >= len(yg[i]) else (yg[i], g[at])
                    big.extend(small)
                    g[at] = big
                else:
                    s.append(ys[i])
                    g.append(yg[i])
        o = sorted(range(len(s)), key=lambda i: -s[i])
        s, g = [s[i] for i in o], [g[i] for i in o]
        state[new] = (s, g)
        heapq.heappush(heap, (-(s[0] - (s[-1] if len(s) == k else 0)), new))
        new += 1
    s, g = state[heap[0][1]]
    sums = np.zeros(k, np.int64)
    for i, (total, members) in enumerate(zip(s, g, strict=True)):
        if begin is not None:
            i = ~min(members)
            members.remove(~i)
        sums[i] = total
        out[members] = i
    return sums, out


def assign(groups: DataFrame, shards: int = SHARDS, cell: int = CELL) -> DataFrame:
    """(grp, bytes) with one row for each group to (grp, bytes, shard). Null sizes count as 0; negative ones too."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = groups.sparkSession
    base = work_dir(spark, "shards")
    groups.select("grp", F.greatest(F.coalesce(F.col("bytes"), F.lit(0)), F.lit(0)).cast("long").alias("bytes")).write.parquet(f"{base}/groups")
    src = spark.read.parquet(f"{base}/groups")
    schema = "grp long, bytes long, shard int"

    def local(begin: np.ndarray | None):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True], kind="stable")
            return pdf[["grp", "bytes"]].assign(shard=difference_weights(pdf["bytes"].to_numpy(), shards, begin)[1])

        return run

    # At most `cell` rows: a partial top-k in each partition, then one task.
    src.orderBy(F.desc("bytes"), F.asc_nulls_first("grp")).limit(cell).groupBy(F.lit(0).alias("one")).applyInPandas(local(None), schema).write.parquet(f"{base}/large")
    large = spark.read.parquet(f"{base}/large")
    last = large.orderBy("bytes", F.desc_nulls_last("grp")).first()
    if last is None:
        return large
    after = F.col("grp") > F.lit(last["grp"]) if last["grp"] is not None else F.col("grp").isNotNull()
    rest = src.where((F.col("bytes") < last["bytes"]) | ((F.col("bytes") == last["bytes"]) & after))
    cells = -(-rest.count() // cell)
    if not cells:
        return large
    sums = np.zeros(shards, np.int64)
    for r in large.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # one row for each shard
        sums[r["shard"]] = r["bytes"]
    keyed = rest.withColumn("cell", F.pmod(F.xxhash64("grp", F.lit(11)), F.lit(cells)))
    keyed.groupBy("cell").applyInPandas(local((sums - sums.min()) // cells), schema).write.parquet(f"{base}/small")
    return large.unionByName(spark.read.parquet(f"{base}/small"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard) for each document: shards of nearly equal bytes of UTF-8 text; equal texts go to one shard.

    A group is a text with all its copies, so no copy is in another shard than its original. A null or an empty text has 0 bytes
    and is in a group with the others like it. Repeated rows are copies. Groups of equal size are ordered by a hash of their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("grp"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("b"))
    groups = rows.groupBy("grp").agg(F.sum("b").alias("bytes"))
    return rows.join(assign(groups, shards, cell), "grp").select("doc_id", "shard")

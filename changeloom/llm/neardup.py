"""Near-duplicate groups by SetSketch.

A document's set of word 3-grams is sketched by registers: register i holds floor(1 - log_b(x)), cut to [0, q + 1], where x is the least
of the set's exponentially distributed hash values. Sketches of parts merge into the union's by the larger register.
Bands of equal registers give candidates, the likelihood of the registers' comparisons estimates the Jaccard similarity of a candidate
pair, and pairs that may reach the threshold are verified on their exact sets. Verified pairs are joined into groups.

Exact copies (equal words) are collapsed first, so only one document of each enters the candidate search. Within a bucket every member
is compared with the bucket's first member; what that leaves in different groups is then compared pair by pair, so no
pair that shares a bucket is passed over and large groups don't cost their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches, fresh, quoted, work_dir
from changeloom.llm.components import connected

SHINGLE, THRESHOLD = 3, 0.55
BANDS, ROWS = 32, 4
M, BASE, RATE, TOP = BANDS * ROWS, 1.001, 20.0, 65535
#: A pair is verified if its estimate is at most this much under the threshold: over 3 standard errors.
SLACK = 0.15
#: Size of the bitmap of candidates that is sent to the executors, 8 MB.
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(2021)
_A = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams, and row starts. A row of fewer words has one shingle: all of them."""
    r = K.Runs(data, off, words_only=True)
    rows = len(off) - 1
    g, row = K.ngrams(r.hash, r.row, n)
    count = np.bincount(r.row, minlength=rows)
    for c in range(1, n):
        few = count == c
        if few.any():
            h, hr = K.ngrams(r.hash, r.row, c)
            at = few[hr]
            g, row = np.concatenate([g, h[at]]), np.concatenate([row, hr[at]])
    if len(row) and (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    return g, K.row_starts(row, rows)


def registers(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers [rows, M] as uint16; rows without shingles have 0 everywhere."""
    rows = len(starts) - 1
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((rows, M), np.uint16)
    if not len(full):
        return out
    x = (g >> K.U64(32)).astype(np.uint32)
    at, buf, least = starts[:-1][full], np.empty_like(x), np.empty((M, len(full)), np.uint32)
    for i in range(M):
        np.multiply(x, _A[i], out=buf)
        np.add(buf, _B[i], out=buf)
        least[i] = np.minimum.reduceat(buf, at)
    e = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of the sets."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> np.ndarray:
    """Estimated set sizes, by row."""
    return M * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(BASE ** -regs.astype(float), axis=-1))


def joint(ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard estimates from the counts of registers that are larger, smaller and equal."""
    na, nb = cardinality(ra), cardinality(rb)
    u = na / (na + nb)
    v = 1 - u
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - more - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)

    def loglik(j: np.ndarray) -> np.ndarray:
        x, y = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return more * np.log(np.maximum(x, 1e-12)) + less * np.log(np.maximum(y, 1e-12)) + same * np.log(np.maximum(1 - x - y, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = loglik(a) < loglik(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """[rows, BANDS] hashes of the bands' registers and numbers."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * K.U64(0x632BE59BD9B4E019)
    for k in range(ROWS):
        h = K.mix(h ^ (r[:, :, k] + K.U64(1 + k)))
    return h.view(np.int64)


@K.lean
def _sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, doc_id, text) to (k, doc_id, e1, e2, regs, bands); bands are null where there is no word, e1 and e2 where there is no text.

    Without a word e1 and e2 are of the whole text.
    """
    for b in it:
        data, off = K.text_of(b.column(2), lower=True)
        for lo, hi in K.slices(off):
            g, s = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            regs = registers(g, s)
            full = np.flatnonzero(np.diff(s))
            e = np.zeros((2, hi - lo), np.uint64)
            if len(full):
                for i, h in enumerate((g, K.mix(g ^ K.U64(0x51ED270B)))):
                    e[i, full] = np.add.reduceat(h, s[:-1][full])
            size = np.diff(off[lo : hi + 1])
            bare = np.flatnonzero((np.diff(s) == 0) & (size > 0))
            if len(bare):
                h = K.span_hashes(data, off[lo + bare], off[lo + bare + 1])
                e[0, bare], e[1, bare] = K.mix(h ^ K.U64(0x2545F4914F6CDD1D)), K.mix(h ^ K.U64(0x51ED270B))
            none = size == 0
            bands = band_hashes(regs)
            edge = pa.array(np.arange(0, (hi - lo) * BANDS + 1, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(e[0].view(np.int64), mask=none), pa.array(e[1].view(np.int64), mask=none),
                 pa.array([r.tobytes() for r in regs], pa.binary()), pa.ListArray.from_arrays(edge, pa.array(bands.ravel()), mask=pa.array(np.diff(s) == 0))],
                names=["k", "doc_id", "e1", "e2", "regs", "bands"],
            )


def _shared_bands(words: np.ndarray):
    """(k, bands) to (band, k) of the bands whose bit is set."""
    shared = words.tobytes()

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared, np.uint64)
        for b in it:
            band = b.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            at = _bit(band)
            on = np.flatnonzero((bits[at >> K.U64(6)] >> (at & K.U64(63))) & K.U64(1))
            yield pa.RecordBatch.from_arrays([pa.array(band[on]), b.column(0).take(pa.array(row[on]))], names=["band", "k"])

    return run


def _sets(words: np.ndarray):
    """(k, text) to (k, x) for the rows whose key's bit is set: x has the distinct shingles."""
    shared = words.tobytes()

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared, np.uint64)
        for b in it:
            at = _bit(b.column(0).to_numpy())
            b = b.filter(pa.array((bits[at >> K.U64(6)] >> (at & K.U64(63))) & K.U64(1) == 1))
            data, off = K.text_of(b.column(1), lower=True)
            for lo, hi in K.slices(off):
                g, s = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                x = (g >> K.U64(32)).astype(np.uint32)
                sets = [np.unique(x[s[i] : s[i + 1]]).view(np.int32) for i in range(hi - lo)]
                edge = np.concatenate([[0], np.cumsum([len(v) for v in sets])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(sets)))], names=["k", "x"])

    return run


def _bit(k: np.ndarray) -> np.ndarray:
    return k.view(np.uint64) & K.U64(FILTER_BITS - 1)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of keys, FILTER_BITS long however many there are: fuller ones let more rows pass, never fewer."""
    at = F.col("k").bitwiseAND(F.lit(FILTER_BITS - 1))
    got = ids.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(k & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return out


def listed(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether a key's bit is set in the bitmap of the ids' keys k: true for each of them, and for a few others."""
    words = ids.sparkSession.sparkContext.broadcast(_filter_of(ids))

    @F.pandas_udf("boolean")
    def found(keys: pd.Series) -> pd.Series:
        at = _bit(keys.to_numpy())
        return pd.Series((words.value[at >> K.U64(6)] >> (at & K.U64(63))) & K.U64(1) == 1)

    return found


def _estimate(least: float):
    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 4096):
                p = b.slice(lo, 4096)
                ra, rb = (np.frombuffer(b"".join(p.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], names=["a", "b"]).filter(pa.array(joint(ra, rb) >= least))

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, root, copy) for each row in a group of two or more, and the sketches; key is a hash of id and text.

    root is the key of the group's document with the least doc_id (nulls first); copy numbers the rows with one key.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    base = work_dir(spark, "neardup")
    src = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    sk = kept(src.mapInArrow(_sketch, "k long, doc_id long, e1 long, e2 long, regs binary, bands array<long>"), "sketch")
    texts = sk.where("e1 is not null")
    exact = kept(texts.groupBy("e1", "e2").agg(F.min("k").alias("rep"), F.count("*").alias("n")), "exact")
    reps = sk.where("bands is not null").select("k", "bands").join(exact.select(F.col("rep").alias("k")), "k", "left_semi").dropDuplicates(["k"])
    # The hub is a bucket's least member. Partial aggregates take a hot bucket apart, and only rows of buckets with several members are joined.
    reps = kept(reps, "reps")
    hubs = kept(reps.select("k", F.explode("bands").alias("band")).groupBy("band").agg(F.min("k").alias("hub"), F.max("k").alias("last")).where("hub < last").select("band", "hub"), "hubs")
    members = kept(reps.mapInArrow(_shared_bands(_filter_of(hubs.select(F.col("band").alias("k")))), "band long, k long").join(hubs, "band"), "members")
    star = kept(members.where("hub < k").select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct(), "star")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        # Registers of rows that are in no pair stay where they are.
        regs = sk.select("k", "regs").where(listed(pairs.select(F.explode(F.array("a", "b")).alias("k")))(F.col("k"))).dropDuplicates(["k"])
        near = kept(
            pairs.join(regs.select(F.col("k").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("k").alias("b"), F.col("regs").alias("rb")), "b").select("a", "b", "ra", "rb").mapInArrow(_estimate(threshold - SLACK), "a long, b long"),
            f"{name}_near",
        )
        # The candidates' sets are made where their texts are; the corpus isn't shuffled.
        chosen = _filter_of(near.select(F.explode(F.array("a", "b")).alias("k")))
        sets = kept(src.select("k", "text").mapInArrow(_sets(chosen), "k long, x array<int>"), f"{name}_sets").groupBy("k").agg(F.first("x").alias("x"))
        pairs = near.join(sets.select(F.col("k").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("k").alias("b"), F.col("x").alias("xb")), "b")
        both = F.size(F.array_intersect("xa", "xb"))
        return kept(pairs.select("a", "b", (both / (F.size("xa") + F.size("xb") - both)).alias("j")).where(F.col("j") >= threshold), f"{name}_pairs")

    first = verified(star, "star")
    comp = connected(first.select("a", "b"))
    named = members.join(comp.withColumnRenamed("id", "k"), "k", "left").withColumn("c", F.coalesce("root", "k")).select("band", "k", "c")
    mixed = named.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 < c1 and size > 2").select("band")
    split = kept(named.join(mixed, "band", "left_semi"), "split")
    x, y = split.alias("x"), split.alias("y")
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    second = verified(kept(rest, "rest"), "rest")
    comp = connected(first.select("a", "b").union(second.select("a", "b"))).withColumnRenamed("id", "rep")
    # Each row's group: its exact copies' representative, then that one's component.
    groups = exact.join(comp, "rep", "left").withColumn("g", F.coalesce("root", "rep")).select("e1", "e2", "g", "n")
    several = groups.groupBy("g").agg(F.sum("n").alias("total")).where("total > 1").select("g")
    rows = kept(texts.select("k", "doc_id", "e1", "e2").join(groups.join(several, "g", "left_semi"), ["e1", "e2"]).select("k", "doc_id", "g"), "rows")
    # In the least of the pairs a null id comes first.
    first_of = rows.groupBy("g").agg(F.min(F.struct("doc_id", "k")).alias("least")).select("g", F.col("least.k").alias("root"), F.col("least.doc_id").alias("root_id"))
    in_group = rows.join(first_of, "g").withColumn("copy", F.row_number().over(Window.partitionBy("k").orderBy("doc_id")))
    return kept(in_group.select("k", "doc_id", "root", "root_id", "copy"), "groups"), sk


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_id) for each row that repeats or nearly repeats another: the group's least doc_id stays.

    Documents are in one group if a chain of pairs with Jaccard similarity of their sets of word 3-grams of at least `threshold` connects them.
    Words ignore case and punctuation. A text of one or two words is compared as a whole, and so is one without words,
    in all its bytes. Null and empty texts are in no group, even if they are equal. Rows that repeat with their id and text are copies of each other: all but one
    are returned. A null doc_id sorts first, so it stays. Other columns are ignored, whatever their names.
    """
    groups, _ = near_groups(docs, threshold, id_col, text_col)
    return groups.where("k != root or copy > 1").select("doc_id", F.col("root_id").alias("kept_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that `near_duplicates` returns, with all their columns."""
    groups, _ = near_groups(docs, threshold, id_col, text_col)
    k, hit, mark = fresh(docs, "k", "hit", "mark")
    gone = groups.where("k != root").select("k").distinct()
    twice = groups.where("copy = 2 and k = root").select("k").distinct()
    # Rows whose bit isn't set stay where they are; only the others, the copies and a few more, are shuffled.
    marked = docs.withColumn(k, F.xxhash64(F.col(id_col), F.col(text_col))).withColumn(hit, listed(gone.union(twice))(F.col(quoted(k))))
    some = marked.where(F.col(hit)).join(gone.withColumnRenamed("k", k), k, "left_anti").join(twice.select(F.col("k").alias(k), F.lit(0).cast("long").alias(mark)), k, "left")
    once = some.withColumn(mark, F.coalesce(mark, F.monotonically_increasing_id() + 1)).dropDuplicates([k, mark])
    columns = [F.col(quoted(c)) for c in docs.columns]
    return marked.where(~F.col(hit)).select(columns).unionByName(once.select(columns))

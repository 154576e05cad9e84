"""Quality classifier: Naive Bayes support vectors.

A document is a set of n-gram indicators. Each indicator is scaled by its log-count ratio between the classes, and a
linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent. The n-grams come from two
streams: the tokens themselves (1 and 2 at a time), and their shapes (1 to 3 at a time), where a word's shape
is its letter case or "as the word before" and a run of symbols is itself. Scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches, bounded_sample, fresh
from changeloom.llm.svm import fit_dual

BITS = 18
#: Labelled rows that the fit looks at, at most (in expectation).
TRAIN_ROWS = 5000
SCHEMA = "doc_id long, score double, quality_pred int"

_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4


def indicators(data: np.ndarray, off: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each row as (row, feature), sorted by row. skip: n-grams of the first row that are left out at its start."""
    r = K.Runs(data, off)
    if not len(r.hash):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flags = np.bitwise_or.reduceat(_KIND[data], r.start)
    first = _KIND[data[r.start]]
    word = r.cls == K.WORD
    shape = flags.astype(K.U64) + K.U64(8) * ((first == 2) & (r.end - r.start > 1)).astype(K.U64)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] & word[:-1] & (r.hash[1:] == r.hash[:-1]) & (r.row[1:] == r.row[:-1])
    shape[again] = 64
    shape = np.where(word, K.mix(shape + K.U64(0x5BD1E995)), r.hash)
    keys = []
    for stream, orders in ((r.hash, (1, 2)), (shape, (1, 2, 3))):
        for n in orders:
            g, row = K.ngrams(stream, r.row, n)
            if stream is shape:
                g = K.mix(g ^ K.U64(0x1234567))
            g, row = g[skip:], row[skip:]
            keys.append((row << BITS) | (g >> K.U64(64 - BITS)).astype(np.int64))
    k = np.sort(np.concatenate(keys))
    k = k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k
    return k >> BITS, k & ((1 << BITS) - 1)


def in_parts(data: np.ndarray, off: np.ndarray, size: int = K.SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, row, feature): `indicators` of rows lo to hi. A long row is read in parts that overlap by three whole tokens and the one before them."""
    for lo, hi in K.slices(off, size):
        data_, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if len(data_) <= 2 * size:
            yield lo, hi, *indicators(data_, o)
            continue
        cuts, _ = K.cut_rows(data_, o, lambda d: d <= 32, size)
        found = np.empty(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            back, from_, step = [], a, 256
            while from_ and len(back) < 5:
                from_ = max(0, a - step)
                while from_ and data_[from_] & 0xC0 == 0x80:
                    from_ -= 1
                back = K.Runs(data_[from_:a], np.array([0, a - from_])).start + from_
                step *= 4
            begin = int(back[-4]) if len(back) > 4 or (from_ == 0 and len(back) > 3) else 0
            _, f = indicators(data_[begin:b], np.array([0, b - begin]), int(begin > 0))
            found = np.union1d(found, f)
        yield lo, hi, np.zeros(len(found), np.int64), found


@dataclass
class Model:
    weight: np.ndarray  # log-count ratio times hinge-loss weight, by hashed n-gram
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decision values (above 0: good), and whether the row has a token."""
        out, any_ = np.empty(len(off) - 1), np.zeros(len(off) - 1, bool)
        for lo, hi, row, f in in_parts(data, off):
            starts = K.row_starts(row, hi - lo)
            n = np.diff(starts)
            out[lo:hi] = K.row_sums(self.weight[f], starts) / np.sqrt(np.maximum(1, n)) + self.bias
            any_[lo:hi] = n > 0
        return out, any_


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, smooth: float = 1.0, c: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on about `rows` labelled documents of each label at most, chosen by a hash of the id; their whole texts are read.

    Labels that are null, and labels whose document is missing or has no text, aren't used. A document with several labels
    counts once for each distinct one. With one class only, every document gets that class; with none, every one is kept.
    """
    bounded_batches(docs)
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and i is not null").distinct()
    lab = bounded_sample(lab, F.col("i"), rows, F.col("y"))
    text = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")

    @K.lean
    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = K.text_of(b.column(0))
            feats: list[bytes] = []
            for lo, hi, row, f in in_parts(data, off):
                s = K.row_starts(row, hi - lo)
                feats += [f[s[i] : s[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(feats, pa.binary())], names=["i", "y", "f"])

    # The labels are the small side: at most 2 * rows of them, a bound that doesn't grow with the data.
    got = text.join(F.broadcast(lab), "i").select("t", "i", "y").mapInArrow(extract, "i long, y int, f binary").collect()
    got = sorted((r[0], r[1], r[2]) for r in got if r[2])
    if not got:
        return Model(np.zeros(1 << BITS, np.float32), 1.0)
    idx = [np.frombuffer(r[2], np.int32) for r in got]
    y = np.array([1 if r[1] else -1 for r in got])
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for k, s in zip(idx, y, strict=True):
        (p if s > 0 else q)[k] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ptr = np.concatenate([[0], np.cumsum([len(k) for k in idx])])
    value = np.concatenate([ratio[k] / np.sqrt(len(k)) for k in idx])
    w, b = fit_dual(ptr, np.concatenate(idx), value, y, 1 << BITS, c=c)
    return Model((w * ratio).astype(np.float32), b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, decision value, and quality 1 where it is above 0.

    Null texts, empty ones and ones of white space alone have no n-gram: they get score -1 and quality 0. Repeated rows
    get equal scores. A score of exactly 0 counts as 0. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s, any_ = shared.value.scores(*K.text_of(b.column(1)))
            s = np.where(any_, s, -1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s > 0).astype(np.int32))], names=["doc_id", "score", "quality_pred"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with quality 1 by `score`, with all their columns; a map, no join."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (t,) = fresh(docs, "t")

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s, any_ = shared.value.scores(*K.text_of(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema([b.schema.field(i) for i in range(b.num_columns - 1)])).filter(pa.array(any_ & (s > 0)))

    return docs.withColumn(t, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)

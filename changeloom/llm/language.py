"""Language identification by hierarchical discrimination.

First the language family is predicted, then linear support vector machines, one for each pair of languages of that
family, vote on the language. All machines read relative frequencies of lower-cased byte 2- to 4-grams, hashed; the
frequencies of a whole text are gathered in one pass, so scoring is a map over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches, bounded_sample, fresh
from changeloom.llm.svm import fit_dual

FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "af", "fy", "lb", "sv", "da", "no", "nb", "nn", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"), "romance"),
    **dict.fromkeys(("pl", "cs", "sk", "ru", "uk", "bg", "hr", "sr", "sl"), "slavic"),
}
BITS, ORDERS, SCALE = 16, (2, 3, 4), 32.0
#: Neutral n-grams that each text's margin is shrunk by, as if it had so many more: little text is little evidence.
PRIOR = 100
#: Rows for each language that the fit looks at, at most (in expectation).
TRAIN_PER_LANGUAGE = 800
SCHEMA = "doc_id long, family string, lang_pred string, margin double, lang string, accepted boolean"


def _grams(data: np.ndarray, off: np.ndarray, before: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams by order, and their row starts. Runs of anything but letters count as one blank.

    before: so many bytes belong to a part of the row that was read before, so n-grams that lie in them aren't given again.
    """
    cls = K.classes(data)
    digit = (data >= 48) & (data <= 57)
    blank = (cls != K.WORD) | digit
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep |= first
    at = np.flatnonzero(keep)
    d = np.where(blank[at], 32, data[at]).astype(np.uint32)
    starts = np.searchsorted(at, off)
    n = len(d)
    row_end = np.repeat(starts[1:], np.diff(starts))
    g = d
    for k in range(1, max(ORDERS)):
        m = max(0, n - k)
        g = g[:m] * np.uint32(0x01000193) + d[k:]
        if k + 1 in ORDERS:
            ok = row_end[:m] > np.arange(m) + k
            if before:
                ok &= at[k : k + m] >= before
            h = (g[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            yield h, np.searchsorted(np.flatnonzero(ok), starts)


def _in_parts(part: np.ndarray, size: int = K.SLICE) -> Iterator[np.ndarray]:
    """Hashed n-grams of one row, some at a time, each once. A part is read with what the n-grams that reach into it need from before it."""
    n, lo = len(part), 0
    while lo < n:
        hi, back = min(n, lo + size), lo
        while hi < n and part[hi] & 0xC0 == 0x80:  # not within a character
            hi -= 1
        if lo:
            # From the third symbol before: three changes of blank and letter, or three letters, whichever is further back.
            kept = 0
            while back and kept <= max(ORDERS):
                step = max(0, back - 64)
                while step and part[step] & 0xC0 == 0x80:
                    step -= 1
                back, kept = step, _symbols(part[step:lo])
        for h, _ in _grams(part[back:hi], np.array([0, hi - back]), lo - back):
            yield h
        lo = hi


def _symbols(part: np.ndarray) -> int:
    blank = (K.classes(part) != K.WORD) | ((part >= 48) & (part <= 57))
    return int((~blank).sum() + (blank[1:] & ~blank[:-1]).sum())


def features(data: np.ndarray, off: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of one row and their scaled frequencies."""
    c = np.zeros(1 << BITS)
    for h in _in_parts(data[off[r] : off[r + 1]]):
        c += np.bincount(h, minlength=1 << BITS)
    k = np.flatnonzero(c)
    return k.astype(np.int32), (c[k] * (SCALE / max(1, c.sum()))).astype(np.float32)


@dataclass
class Model:
    """languages by family, and one machine for each pair of families and each pair of languages of a family."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # ("" or the family, first, second)
    weights: np.ndarray  # [2 ** BITS, pairs]
    bias: np.ndarray

    def scores(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decision values by row and pair, and the row's number of n-grams."""
        total, count = np.zeros((len(off) - 1, len(self.pairs))), np.zeros(len(off) - 1)
        for lo, hi in K.slices(off):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if len(part) > 2 * K.SLICE:  # one long row
                for h in _in_parts(part):
                    total[lo] += self.weights[h].sum(0, dtype=float)
                    count[lo] += len(h)
                continue
            for h, starts in _grams(part, o):
                total[lo:hi] += K.row_sums(self.weights[h], starts)
                count[lo:hi] += np.diff(starts)
        return total * (SCALE / np.maximum(1, count))[:, None] + self.bias, count

    def vote(self, scores: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index into names with the most won pairs (then the largest sum of margins, then the first), and its least margin."""
        n = len(scores)
        if len(names) == 1:
            return np.zeros(n, int), np.full(n, np.inf)
        wins, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
        least = np.full((n, len(names)), np.inf)
        for j, (at, a, b) in enumerate(self.pairs):
            if at == level:
                for name, s in ((a, scores[:, j]), (b, -scores[:, j])):
                    i = names.index(name)
                    wins[:, i] += s > 0
                    sums[:, i] += s
                    least[:, i] = np.minimum(least[:, i], s)
        best = np.argmax(wins * 1e6 + np.clip(sums, -1e5, 1e5), axis=1)
        return best, least[np.arange(n), best]

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """Family, language and margin of each row; "und" and 0 for rows without letters."""
        s, count = self.scores(data, off)
        any_ = count > 0
        names = sorted(self.families)
        fam, margin = self.vote(s, "", names)
        family, lang = np.full(len(s), "und", object), np.full(len(s), "und", object)
        for i, f in enumerate(names):
            at = np.flatnonzero((fam == i) & any_)
            if len(at):
                best, least = self.vote(s[at], f, self.families[f])
                family[at] = f
                lang[at] = np.array(self.families[f], object)[best]
                margin[at] = np.minimum(margin[at], least)
        margin = np.where(np.isinf(margin), 1.0, margin) * (count / (count + PRIOR))
        return list(family), list(lang), margin


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on about per_language labelled rows of each language, chosen by a hash of the id; their whole texts are read.

    Rows whose language or text is null aren't used. No usable row: a model that answers "und" for everything.
    """
    bounded_batches(docs)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")

    @K.lean
    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = K.text_of(b.column(0), lower=True)
            f = [features(data, off, r) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([k.tobytes() for k, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary())], names=["l", "k", "v"])

    got = bounded_sample(rows, F.col("i"), per_language, F.col("l")).select("t", "l").mapInArrow(extract, "l string, k binary, v binary").collect()
    got = sorted(r for r in map(tuple, got) if len(r[1]))
    langs = sorted({r[0] for r in got})
    families: dict[str, list[str]] = {}
    for x in langs:
        families.setdefault(FAMILIES.get(x.lower().split("-")[0], x), []).append(x)
    idx = [np.frombuffer(r[1], np.int32) for r in got]
    val = [np.frombuffer(r[2], np.float32) for r in got]
    lang = np.array([r[0] for r in got], object)
    fam = np.array([FAMILIES.get(x.lower().split("-")[0], x) for x in lang], object)
    pairs, ws, bs = [], [], []
    for level, names, of in [("", sorted(families), fam), *((f, ls, lang) for f, ls in sorted(families.items()))]:
        for a, b in combinations(names, 2):
            rows_ = np.flatnonzero((of == a) | (of == b))
            y = np.where(of[rows_] == a, 1, -1)
            ptr = np.concatenate([[0], np.cumsum([len(idx[i]) for i in rows_])])
            w, bias = fit_dual(ptr, np.concatenate([idx[i] for i in rows_]), np.concatenate([val[i] for i in rows_]).astype(float), y, 1 << BITS)
            pairs.append((level, a, b))
            ws.append(w)
            bs.append(bias)
    weights = np.array(ws, np.float32).T.copy() if ws else np.zeros((1 << BITS, 0), np.float32)
    return Model(families or {"und": ["und"]}, pairs, weights, np.array(bs))


def accepts(pred: list[str], margin: np.ndarray, declared: list[str | None], known: set[str], reject_margin: float) -> np.ndarray:
    """A row is rejected if it has no letters, or if it is confidently of another language than the known one that it declares."""
    return np.array([p != "und" and not (d in known and d != p and m >= reject_margin) for p, d, m in zip(pred, declared, margin, strict=True)], bool)


def identify(docs: DataFrame, model: Model, reject_margin: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: id, family, predicted language, margin, declared language, accepted.

    The margin is the least decision value among the machines that the winning language was compared in, shrunk by PRIOR neutral n-grams. Null and empty
    texts, and texts without letters, get family and language "und", margin 0, and aren't accepted. A null declared language is
    accepted with any prediction. Repeated rows get equal answers; a tie in votes goes to the larger sum of
    margins, then to the name that sorts first. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs)
    known = {x for v in model.families.values() for x in v}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            family, lang, margin = m.predict(*K.text_of(b.column(1), lower=True))
            ok = accepts(lang, margin, b.column(2).to_pylist(), known, reject_margin)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(margin), b.column(2), pa.array(ok)], names=["doc_id", "family", "lang_pred", "margin", "lang", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, reject_margin: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that `identify` accepts, with all their columns; a map, no join."""
    bounded_batches(docs)
    known = {x for v in model.families.values() for x in v}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    t, d = fresh(docs, "t", "d")

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            _, lang, margin = m.predict(*K.text_of(b.column(b.num_columns - 2), lower=True))
            ok = accepts(lang, margin, b.column(b.num_columns - 1).to_pylist(), known, reject_margin)
            yield pa.RecordBatch.from_arrays(b.columns[:-2], schema=pa.schema([b.schema.field(i) for i in range(b.num_columns - 2)])).filter(pa.array(ok))

    return docs.withColumns({t: F.col(text_col).cast("string"), d: F.col(lang_col).cast("string")}).mapInArrow(run, docs.schema)

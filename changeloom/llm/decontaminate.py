"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds: runs of MIN_MATCH equal words. For each pair so found, the longest
common runs that don't overlap are marked again and again, until none of MIN_MATCH words is left. The next length to mark is found by
running Karp-Rabin: the hash of each window of unmarked words follows from running sums, and the windows of both sides meet by hash. The share of the item's words that tiles cover decides, so passages whose parts were
reordered or spread over a document count in full.

The benchmark is the small side. It is cut into parts of a bounded number of words; each is broadcast and met
by one map over the documents, so a larger benchmark costs passes, not memory, and the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches, fresh

MIN_MATCH, COVERAGE = 5, 0.5
#: Benchmark words that are broadcast at once.
PART_WORDS = 4_000_000
SCHEMA = "doc_id long, item_id long, covered int, item_words int, coverage double, tiles int"


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word; long rows are read in parts that end at white space."""
    cuts, row = K.cut_rows(data, off, lambda d: d <= 32)
    hashes, rows = [np.empty(0, K.U64)], [np.empty(0, np.int64)]
    for lo, hi in K.slices(cuts):
        r = K.Runs(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], words_only=True)
        hashes.append(r.hash)
        rows.append(row[lo + r.row])
    return np.concatenate(hashes), np.concatenate(rows)


class Windows:
    """Words of one side, which of them are marked, and Karp-Rabin hashes of their windows."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        power, self.scale = np.full(n + 1, _BASE, K.U64), np.full(n + 1, _INVERSE, K.U64)
        power[0] = self.scale[0] = 1
        power, self.scale = np.multiply.accumulate(power), np.multiply.accumulate(self.scale)
        self.total = np.zeros(n + 1, K.U64)
        np.cumsum(K.mix(h) * power[:n], out=self.total[1:])
        self.marked = np.zeros(n, bool)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of n unmarked words, and their hashes."""
        run = np.zeros(len(self.marked) + 1, np.int64)
        np.cumsum(self.marked, out=run[1:])
        at = np.flatnonzero(run[n:] == run[: max(0, len(run) - n)])
        return at, (self.total[at + n] - self.total[at]) * self.scale[at]

    def next_free(self, at: int, n: int) -> int:
        """at, or the place after the last marked word of the window there."""
        hit = np.flatnonzero(self.marked[at : at + n])
        return at + int(hit[-1]) + 1 if len(hit) else at


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sides' word hashes: tiles (place in doc, place in item, length).

    The longest run is marked first, then the one that is first in the item, then in the document. While a common run of a length is left, one of
    each smaller length is, so the greatest is found by halving. Nothing has the size of the pairs of equal places.
    """
    d, t = Windows(doc), Windows(item)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= seed:
        lo, hi = seed - 1, most  # a common run of lo words is there (or lo is too short), none of more than hi
        step = seed
        while lo < hi:
            n = min(hi, max(lo + 1, step))
            if np.isin(t.of(n)[1], d.of(n)[1]).any():
                lo, step = n, min(2 * n, (n + hi + 1) // 2 if n >= hi // 2 else 2 * n)
            else:
                hi = n - 1
                step = (lo + hi + 1) // 2
        if lo < seed:
            break
        n = lo
        at, h = d.of(n)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        for j, g in zip(*t.of(n), strict=True):
            a, b = int(np.searchsorted(h, g, "left")), int(np.searchsorted(h, g, "right"))
            if a == b or t.marked[j : j + n].any():
                continue
            while a < b and (free := d.next_free(int(at[a]), n)) != at[a]:
                a += int(np.searchsorted(at[a:b], free, "left"))
            if a < b:
                i = int(at[a])
                tiles.append((i, int(j), n))
                d.marked[i : i + n] = t.marked[j : j + n] = True
        most = n - 1
    return tiles


@dataclass
class Part:
    """Seeds of some benchmark items by hash and item, and a bitmap that answers most look-ups."""

    item: np.ndarray  # ids
    size: np.ndarray  # words
    words: np.ndarray  # hashes of all items' words
    first: np.ndarray  # where each item's words start
    seeds: np.ndarray  # hash, sorted; one entry for each hash and item
    of: np.ndarray  # index of the item
    pos: np.ndarray  # places of all entries in their items
    edge: np.ndarray  # where each entry's places start
    seed: int
    bits: int = 22
    short: list[Part] = field(default_factory=list)  # items of fewer words, by their number of words: it is their seed

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.seeds >> K.U64(64 - self.bits)] = True

    @classmethod
    def build(cls, ids: list[int], texts: list[str], seed: int) -> Part:
        h, row = words(*K.text_of(pa.array(texts, pa.string()), lower=True))
        size = np.bincount(row, minlength=len(ids))
        g, r = K.ngrams(h, row, seed)
        start = np.searchsorted(r, np.arange(len(ids)))
        pos = np.arange(len(r)) - start[r]
        order = np.lexsort((pos, r, g))
        g, r, pos = g[order], r[order], pos[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        short = []
        for n in range(1, seed):
            if len(few := np.flatnonzero(size == n)):
                short.append(cls.build([ids[i] for i in few], [texts[i] for i in few], n))
                short[-1].of = few[short[-1].of]
                short[-1].size = size
        return cls(np.array(ids, np.int64), size, h, np.searchsorted(row, np.arange(len(ids))), g[at], r[at], pos, np.append(at, len(g)), seed, short=short)

    def hits(self, data: np.ndarray, off: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item index, covered words, tiles) of each pair that reaches the coverage; items of fewer words than the seed have to be covered in full."""
        for p in self.short:
            yield from p.hits(data, off, 1.0)
        if not len(self.seeds):
            return
        for lo, hi in K.slices(off):
            h, row = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            g, r = K.ngrams(h, row, self.seed)
            if not len(g):
                continue
            at = np.flatnonzero(self.seen[g >> K.U64(64 - self.bits)])
            a = np.searchsorted(self.seeds, g[at], "left")
            known = a < len(self.seeds)
            known[known] = self.seeds[a[known]] == g[at[known]]
            at, a = at[known], a[known]  # places of the documents that hold a seed, and the seed's first entry
            edges = np.searchsorted(r[at], np.arange(hi - lo + 1))
            words_from, seeds_from = K.row_starts(row, hi - lo), K.row_starts(r, hi - lo)
            for n in np.flatnonzero(np.diff(edges)):
                here = slice(edges[n], edges[n + 1])
                for k, covered, tiles in self._row(h[words_from[n] : words_from[n + 1]], at[here] - seeds_from[n], a[here], coverage):
                    yield lo + int(n), k, covered, tiles

    def _row(self, h: np.ndarray, at: np.ndarray, entry: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int]]:
        """(item index, covered words, tiles) for one document. Each of its distinct seeds is met once with each item that has it, however often they repeat."""
        kinds = np.unique(entry)
        n = np.searchsorted(self.seeds, self.seeds[kinds], "right") - kinds
        e = np.repeat(kinds - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kind = np.repeat(kinds, n)
        order = np.argsort(self.of[e], kind="stable")
        e, kind = e[order], kind[order]
        cut = np.flatnonzero(np.concatenate([[True], self.of[e[1:]] != self.of[e[:-1]]]))
        for s, t in zip(cut, np.append(cut[1:], len(e)), strict=True):
            k = int(self.of[e[s]])
            size = int(self.size[k])
            if size == self.seed:  # any seed is the whole item
                if coverage <= 1:
                    yield k, self.seed, 1
                continue
            j = np.concatenate([self.pos[self.edge[x] : self.edge[x + 1]] for x in e[s:t]])
            mark = np.zeros(size + 1, int)
            np.add.at(mark, j, 1)
            np.add.at(mark, j + self.seed, -1)
            if (np.cumsum(mark)[:-1] > 0).sum() < coverage * size:
                continue  # tiles cover no more than the seeds do
            # The document's words that a shared seed covers; a word that is nowhere else stands between stretches.
            mine = at[np.isin(entry, kind[s:t])]
            near = np.zeros(len(h) + 1, np.int64)
            np.add.at(near, mine, 1)
            np.add.at(near, mine + self.seed, -1)
            near = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            gap = np.flatnonzero(np.diff(near) > 1) + 1
            side = np.insert(h[near], gap, K.mix(np.arange(len(gap)).astype(np.uint64) + K.U64(0xA5A5A5A5)))
            tiles = tile(side, self.words[self.first[k] : self.first[k] + size], self.seed)
            covered = sum(x[2] for x in tiles)
            if covered >= coverage * size:
                yield k, covered, len(tiles)


def parts(benchmark: DataFrame, seed: int = MIN_MATCH, part_words: int = PART_WORDS, id_col: str = "item_id", text_col: str = "text") -> list[Part]:
    """The benchmark in broadcast parts. Null items and items without words can't match."""
    out: list[Part] = []
    ids, texts, total = [], [], 0
    for i, t in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(-1 if i is None else i)
        texts.append(t)
        total += len(t) // 4 + 1
        if total >= part_words:
            out.append(Part.build(ids, texts, seed))
            ids, texts, total = [], [], 0
    return [*out, Part.build(ids, texts, seed)] if ids else out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """One row for each document and benchmark item of which tiles cover at least `coverage`.

    Words ignore case and punctuation. Null and empty texts match nothing; an item of fewer than `seed` words matches where
    all its words stand in a row, whatever the coverage asked for; an item without id is returned as -1. Among runs of equal length the one first in the item, then in
    the document, is marked first. Repeated documents and repeated items give a row each. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for p in parts(benchmark, seed, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        @K.lean
        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for b in it:
                found = list(q.hits(*K.text_of(b.column(1), lower=True), coverage))
                row, k, covered, tiles = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(q.item[k]), pa.array(covered.astype(np.int32)), pa.array(q.size[k].astype(np.int32)), pa.array(covered / np.maximum(1, q.size[k])), pa.array(tiles.astype(np.int32))],
                    names=["doc_id", "item_id", "covered", "item_words", "coverage", "tiles"],
                )

        one = src.mapInArrow(run, SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = MIN_MATCH, text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """The rows of docs that `contaminated` returns nothing for, with all their columns; a map, no join."""
    bounded_batches(docs)
    for p in parts(benchmark, seed, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(p)
        (t,) = fresh(docs, "t")

        @K.lean
        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in it:
                keep = np.ones(b.num_rows, bool)
                for row, *_ in shared.value.hits(*K.text_of(b.column(b.num_columns - 1), lower=True), coverage):
                    keep[row] = False
                yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema([b.schema.field(i) for i in range(b.num_columns - 1)])).filter(pa.array(keep))

        docs = docs.withColumn(t, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
    return docs

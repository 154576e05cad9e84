"""Toxic spans by a linear-chain conditional random field.

The chain is a sentence; its tokens are words; the tags are clean and toxic. Emissions come from the word, its prefixes and suffixes, its length
and the prefixes of its neighbours; transitions are learned. Training tokens are labelled from the documents' labels: a word (or
a word's beginning) that is significantly over-represented in toxic documents is a toxic token there, all other tokens are clean.
Forward-backward gives each token's marginal; a document's score is the probability that one of its tokens over
a threshold is toxic, taking the marginals as independent, and these tokens give the offending byte offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm import neardup
from changeloom.llm.common import bounded_batches, bounded_sample, work_dir

BITS = 20
#: Tokens of a piece of a chain: all pieces move together, and messages are carried from one to the next.
PIECE = 64
PREFIXES, SUFFIXES = (3, 4, 5, 6, 8), (3,)
#: Labelled documents of each label that training sentences are taken from, at most (in expectation).
TRAIN_ROWS = 2500
THRESHOLD = 0.9
#: Clean sentences of each labelled document that the fit looks at, besides two for each toxic one.
CLEAN_SENTENCES = 15
SCHEMA = "doc_id long, score double, toxic boolean, starts array<int>, ends array<int>, marginals array<float>"


@dataclass
class Tokens:
    """Words of some rows: hash, byte span, row, and the number of the sentence."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    sentence: np.ndarray


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """Tokens, and the lower-cased bytes that they are spans of. Sentences end at . ! ? and line ends, and with the row."""
    low = K.lower_same_length(data)
    r = K.Runs(low, off, words_only=True)
    stop = np.zeros(len(low) + 1, np.int64)
    np.cumsum((low == 10) | (low == 46) | (low == 33) | (low == 63), out=stop[1:])
    s = stop[r.start]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r.row[1:] != r.row[:-1])
    return Tokens(r.hash, r.start, r.end, r.row, np.cumsum(new) - 1), low


def affixes(t: Tokens, low: np.ndarray) -> dict[str, np.ndarray]:
    """Hashes of each token's own features. A prefix that the word isn't longer than is the word itself."""
    n = len(low)
    size = t.end - t.start
    out = {"w": t.hash}
    value = np.zeros(len(t.hash), np.uint64)
    for k in range(max(PREFIXES)):
        b = low[np.minimum(t.start + k, n - 1)].astype(np.uint64) + np.uint64(1)
        value = value * np.uint64(0x100000001B3) + np.where(size > k, b, np.uint64(0))
        if k + 1 in PREFIXES:
            out[f"p{k + 1}"] = K.mix(value ^ np.uint64(k + 1))
    for k in SUFFIXES:
        value = np.zeros(len(t.hash), np.uint64)
        for i in range(k):
            at = t.end - 1 - i
            value = value * np.uint64(0x100000001B3) + np.where(size > i, low[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out[f"s{k}"] = K.mix(value ^ np.uint64(0x700 + k))
    return out


def own_features(t: Tokens, low: np.ndarray) -> np.ndarray:
    """[tokens, features] indices of each token's own features."""
    a = affixes(t, low)
    return np.stack([_index(h, i) for i, h in enumerate(a.values())], 1)


def _index(h: np.ndarray, kind: int) -> np.ndarray:
    return (K.mix(h ^ np.uint64(0x9E37 + 7919 * kind)) >> np.uint64(32)).astype(np.uint32)


class Weights:
    """Weights by 32-bit feature. A slot holds one feature and its weight, so one that wasn't seen in training weighs nothing."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray) -> None:
        self.feature, self.weight = np.zeros(1 << BITS, np.uint32), np.zeros(1 << BITS, np.float32)
        order = np.argsort(np.abs(weight), kind="stable")  # of two in one slot the heavier stays
        at = self.slot(feature[order])
        self.feature[at], self.weight[at] = feature[order], weight[order]

    @staticmethod
    def slot(feature: np.ndarray) -> np.ndarray:
        return (feature * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)

    def __getitem__(self, feature: np.ndarray) -> np.ndarray:
        at = self.slot(feature)
        return np.where(self.feature[at] == feature, self.weight[at], np.float32(0))


def chains(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sentences, longest first."""
    if not len(sentence):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    length = np.diff(np.append(start, len(sentence)))
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def _messages(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log-odds of tag 1 by token, from the tokens up to it. The longest chain comes first.

    A chain is cut into pieces only for the order of the work: each piece's product of 2 x 2 matrices is made first, these carry the message
    through the chain, and then all pieces go through their tokens from the message that enters them.
    """
    count = -(-length // PIECE)
    base = np.cumsum(count) - count
    chain = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(chain)) - base[chain]
    at, size = start[chain] + nth * PIECE, np.minimum(PIECE, length[chain] - nth * PIECE)
    # Nothing goes over into a chain's first token.
    head = np.where((nth == 0)[:, None, None], 0.0, trans)
    into = np.zeros(len(at))
    more = np.flatnonzero(nth + 1 < count[chain])
    if len(more):
        m = head[more].copy()  # [before, tag]
        m[:, :, 1] += emit[at[more]][:, None]
        for k in range(1, PIECE):
            m = np.stack([np.logaddexp(m[:, :, 0] + trans[0, c], m[:, :, 1] + trans[1, c]) for c in (0, 1)], 2)
            m[:, :, 1] += emit[at[more] + k][:, None]
        place = np.cumsum(nth + 1 < count[chain]) - 1
        for j in range(int(count[0]) - 1):
            p = base[: np.searchsorted(-count, -(j + 1), "left")] + j
            q = m[place[p]]
            into[p + 1] = np.logaddexp(q[:, 0, 1], q[:, 1, 1] + into[p]) - np.logaddexp(q[:, 0, 0], q[:, 1, 0] + into[p])
    f = np.zeros(len(emit))
    f[at] = np.logaddexp(head[:, 0, 1], head[:, 1, 1] + into) - np.logaddexp(head[:, 0, 0], head[:, 1, 0] + into) + emit[at]
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    for k in range(1, int(size[0])):
        here = at[: np.searchsorted(-size, -k, "left")] + k
        o = f[here - 1]
        f[here] = np.logaddexp(trans[0, 1], trans[1, 1] + o) - np.logaddexp(trans[0, 0], trans[1, 0] + o) + emit[here]
    return f


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of tag 1 by token, expected transition counts, and the log partition over all chains.

    emit: score of tag 1 against tag 0. trans: [2, 2] scores from one tag to the next. The chains are all the tokens, longest first.
    With two tags a message is one log-odds, so nothing overflows.
    """
    n = len(emit)
    counts = np.zeros((2, 2))
    if not n:
        return np.zeros(0), counts, 0.0
    f = _messages(emit, trans, start, length)
    r = _messages(emit[::-1], trans.T, n - start - length, length)[::-1]  # from the tokens after it, and its own emission
    logz = float(np.logaddexp(0, f[start + length - 1]).sum())
    inner = np.ones(n, bool)
    inner[start] = False
    inner = np.flatnonzero(inner)
    for k in range(0, len(inner), 1 << 16):
        at = inner[k : k + (1 << 16)]
        a, b = f[at - 1], r[at]
        logz += float(np.logaddexp(trans[0, 0], trans[1, 0] + a).sum())
        cells = np.stack([np.broadcast_to(trans[0, 0], a.shape), trans[0, 1] + b, trans[1, 0] + a, trans[1, 1] + a + b])
        cells = np.exp(cells - cells.max(0))
        counts += (cells / cells.sum(0)).sum(1).reshape(2, 2)
    return 1 / (1 + np.exp(-np.clip(f + r - emit, -500, 500))), counts, logz


@dataclass
class Model:
    own: Weights  # of tag 1 by feature of the token itself
    near: tuple[Weights, Weights]  # of the token before and after, by its 3-byte prefix
    bias: float
    trans: np.ndarray
    known: bool = True

    def emissions(self, t: Tokens, low: np.ndarray) -> np.ndarray:
        # A word occurs many times in a slice: its own features are looked up once.
        _, where, which = np.unique(t.hash, return_index=True, return_inverse=True)
        u = Tokens(t.hash[where], t.start[where], t.end[where], t.row[where], t.sentence[where])
        c = _index(affix3(u, low), 99)
        return combine(self.own[own_features(u, low)].sum(1)[which], self.near[0][c][which], self.near[1][c][which], self.bias, t.sentence)

    def marginals(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Tokens]:
        t, low = tokens(data, off)
        if not self.known or not len(t.hash):
            return np.zeros(len(t.hash)), t
        p, _, _ = forward_backward(self.emissions(t, low), self.trans, *chains(t.sentence))
        return p, t


def combine(own: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float, sentence: np.ndarray) -> np.ndarray:
    """Emissions: a token's own score, and what its neighbours in the sentence add. before: by token, what it adds to the next one."""
    e = own + bias
    same = sentence[1:] == sentence[:-1]
    e[1:] += np.where(same, before[:-1], 0)
    e[:-1] += np.where(same, after[1:], 0)
    return e


def affix3(t: Tokens, low: np.ndarray) -> np.ndarray:
    value = np.zeros(len(t.hash), np.uint64)
    for k in range(3):
        value = value * np.uint64(0x100000001B3) + np.where(t.end - t.start > k, low[np.minimum(t.start + k, len(low) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return K.mix(value)


@K.lean
def _marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, i, y, t) to (k, i, y, m) for the rows with a word: m has 12 minima of the hashed word triples."""
    for b in it:
        data, off = K.text_of(b.column(3))
        for lo, hi in K.slices(off):
            g, s = neardup.shingles(K.lower_same_length(data[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo])
            full = np.flatnonzero(np.diff(s))
            if not len(full):
                continue
            m = np.stack([np.minimum.reduceat(K.mix(g ^ K.U64(k * 0x9E37 + 1)), s[:-1][full]) for k in range(12)], 1)
            at = pa.array(lo + full)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 12), pa.int32()), pa.array(m.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), lists], names=["k", "i", "y", "m"])


_THREE = [np.array(list(combinations(range(n), 3)), int).reshape(-1, 3) for n in range(13)]


@K.lean
def _threes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, i, y, p, m) to (k, i, y, h): a hash of each three of the row's marks m at the places p."""
    for b in it:
        m, p = (b.column(j).flatten().to_numpy() for j in (4, 3))
        at = np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy())])
        v = K.mix(m.view(np.uint64) ^ K.mix(p.astype(np.uint64) + K.U64(1)))
        h = [K.ngrams(v[s + _THREE[e - s]].ravel(), np.repeat(np.arange(len(_THREE[e - s])), 3), 3)[0].view(np.int64) for s, e in zip(at[:-1], at[1:], strict=True)]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in h])])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *h])))], names=["k", "i", "y", "h"])


def distinct_rows(labelled: DataFrame, base: str) -> DataFrame:
    """Rows (k, i, y, t) without those that copy or nearly copy an earlier one: copies would make all their words look over-represented.

    A row is a near copy if 3 of its 12 marks are those of one earlier row, by id. Rows that agree in 3 marks meet at these, so no pairs are made.
    """
    spark = labelled.sparkSession
    labelled.mapInArrow(_marks, "k long, i long, y int, m array<long>").write.parquet(f"{base}/marks")
    marks = spark.read.parquet(f"{base}/marks")
    each = marks.dropDuplicates(["k"]).select("k", "i", "y", F.posexplode("m").alias("p", "m"))
    shared = each.withColumn("n", F.count("*").over(Window.partitionBy("p", "m"))).where("n > 1")
    rows = shared.groupBy("k", "i", "y").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("a")).where("size(a) > 2")
    threes = rows.select("k", "i", "y", F.col("a.p").alias("p"), F.col("a.m").alias("m")).mapInArrow(_threes, "k long, i long, y int, h array<long>")
    me = threes.select(F.struct("i", "y", "k").alias("me"), F.explode("h").alias("h"))
    me.withColumn("first", F.min("me").over(Window.partitionBy("h"))).where("first < me").select("me.k").distinct().write.parquet(f"{base}/gone")
    gone = spark.read.parquet(f"{base}/gone")
    # Rows whose bit isn't set stay where they are; only the others, the copies and a few more, are shuffled.
    hit = neardup.listed(gone.union(marks.groupBy("k").count().where("count > 1").select("k")))(F.col("k"))
    return labelled.where(~hit).unionByName(labelled.where(hit).join(gone, "k", "left_anti").dropDuplicates(["k"]))


WIDE = [0, *(1 + i for i, p in enumerate(PREFIXES) if p >= 4)]
#: Features that a task counts before it passes them on.
COUNTED = 1 << 20


def _summed(f: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(f), return_inverse=True)
    v = np.concatenate(n)
    return u, np.stack([np.bincount(at, v[:, y], len(u)) for y in (0, 1)], 1).astype(np.int64)


@K.lean
def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, t) to (f, neg, pos): rows of each label by feature, and all rows with a word as feature -1. A feature may come more than once."""

    def batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v[:, 0]), pa.array(v[:, 1])], names=["f", "neg", "pos"])

    f, n, size = [], [], 0
    for b in it:
        label = b.column(0).to_numpy()
        data, off = K.text_of(b.column(1))
        for lo, hi in K.slices(off):
            t, low = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            if not len(t.hash):
                continue
            # A word counts once in a row, and its prefixes once.
            _, where = np.unique(K.mix(t.hash + t.row.astype(np.uint64)), return_index=True)
            u = Tokens(t.hash[where], t.start[where], t.end[where], t.row[where], t.sentence[where])
            x = own_features(u, low)[:, WIDE].astype(np.uint64)
            key = np.unique((u.row.astype(np.uint64)[:, None] << K.U64(32)) | x)
            y = label[lo + (key >> K.U64(32)).astype(np.int64)]
            full = label[lo + np.unique(t.row)]
            f.append(np.append((key & K.U64(0xFFFFFFFF)).astype(np.int64), np.full(len(full), -1)))
            y = np.append(y, full)
            n.append(np.stack([y == 0, y == 1], 1).astype(np.int64))
            size += len(y)
            if size > COUNTED:
                u, v = _summed(f, n)
                f, n, size = [u], [v], len(u)
                if size > COUNTED // 2:
                    yield batch(u, v)
                    f, n, size = [], [], 0
    if f:
        yield batch(*_summed(f, n))


def toxic_features(rows: DataFrame, base: str, level: float = 0.01) -> np.ndarray:
    """Features that mark a token of a toxic row as toxic, sorted, from the labels of all the rows (y, t).

    A feature (a word, or a prefix of 4 to 8 bytes) is one if it is in more toxic rows than chance
    allows, and in at most 1 clean row for 20 toxic ones. Chance: with the toxic rows' share q, a feature of k rows is in t toxic
    ones with probability at most exp(-k KL(t / k, q)); that has to be under `level` divided by the number of features.
    """
    one = rows.select("y", "t").mapInArrow(_counts, "f long, neg long, pos long")
    one.groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).write.parquet(f"{base}/counts")
    counts = rows.sparkSession.read.parquet(f"{base}/counts")
    total, feats = counts.where("f = -1").first(), counts.where("f >= 0")
    if not total or not total.pos or not total.neg:
        return np.empty(0, np.uint32)
    q = total.pos / (total.pos + total.neg)
    k = F.col("pos") + F.col("neg")
    a = F.col("pos") / k
    kl = a * F.log(a / q) + F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - q))).otherwise(0.0)
    hot = feats.where((a > max(q, 0.95)) & (k * kl > float(np.log(feats.count() / level)))).select("f").toArrow()["f"].to_numpy()
    return np.sort(hot.astype(np.uint32))


def _sentences(hot: np.ndarray, clean: int):
    """(k, i, y, t) to the sentences that training looks at: those with a toxic token, and some clean ones of each row.

    x and c are the tokens' own and context features, s numbers the sentences within the row, g has the tags. Toxic rows without a toxic token give nothing.
    """

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            key, label = b.column(0).to_numpy(), b.column(2).to_numpy()
            data, off = K.text_of(b.column(3))
            for lo, hi in K.slices(off):
                t, low = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if not len(t.hash):
                    continue
                own, cx = own_features(t, low), _index(affix3(t, low), 99)
                marked = np.isin(own[:, WIDE], hot).any(1)
                at = K.row_starts(t.row, hi - lo)
                rows, out = [], []
                for r in np.flatnonzero(np.diff(at)):
                    of = slice(at[r], at[r + 1])
                    s = t.sentence[of] - t.sentence[at[r]]
                    tag = marked[of] & bool(label[lo + r])
                    if label[lo + r] and not tag.any():
                        continue
                    toxic = np.unique(s[tag])
                    count = int(s.max()) + 1
                    take = np.zeros(count, bool)
                    take[toxic] = True
                    take[np.random.default_rng([5, int(key[lo + r]) & 0xFFFFFFFFFFFFFFFF]).permutation(count)[: clean + 2 * len(toxic)]] = True
                    on = take[s]
                    rows.append(lo + r)
                    out.append([v.tobytes() for v in (own[of][on], cx[of][on], (np.cumsum(take) - 1)[s[on]].astype(np.int32), tag[on])])
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows)), b.column(0).take(pa.array(rows)), *(pa.array(v, pa.binary()) for v in zip(*out, strict=True))], names=["i", "k", "x", "c", "s", "g"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = 60, l2: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Finds the toxic features in all labelled documents, and trains on sentences of about `rows` of each label at most, chosen by a hash of the id.

    Null labels, and labels without a document or text, aren't used. Without toxic documents the model calls nothing toxic.
    """
    bounded_batches(docs)
    base = work_dir(docs.sparkSession, "toxicity")
    lab = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and i is not null").distinct()
    text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null and i is not null")
    # Of the texts only the labelled ones and a few more are shuffled.
    some = text.where(neardup.listed(lab.select(F.xxhash64("i").alias("k")))(F.xxhash64("i")))
    # The same join at every size: labels grow with the documents, so they aren't broadcast.
    some.join(lab.hint("merge"), "i").select(F.xxhash64("i", "y", "t").alias("k"), "i", "y", "t").write.parquet(f"{base}/labelled")
    kept = distinct_rows(docs.sparkSession.read.parquet(f"{base}/labelled"), base)
    hot = toxic_features(kept, base)
    none = Weights(np.empty(0, np.uint32), np.empty(0))
    if not len(hot):
        return Model(none, (none, none), -8.0, np.zeros((2, 2)), False)
    sample = bounded_sample(kept, F.col("i"), rows, F.col("y")).select("k", "i", "y", "t")
    got = sorted(map(tuple, sample.mapInArrow(_sentences(hot, CLEAN_SENTENCES), "i long, k long, x binary, c binary, s binary, g binary").toLocalIterator()))
    x, c, s, y = (np.concatenate([np.empty(0, kind), *(np.frombuffer(r[j], kind) for r in got)]) for j, kind in ((2, np.uint32), (3, np.uint32), (4, np.int32), (5, bool)))
    if not y.any():
        return Model(none, (none, none), -8.0, np.zeros((2, 2)), False)
    row = np.repeat(np.arange(len(got)), [len(r[5]) for r in got])
    del got
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return train(x.reshape(len(y), -1), c, np.cumsum(new) - 1, y, epochs, l2)


def train(x: np.ndarray, c: np.ndarray, sentence: np.ndarray, y: np.ndarray, epochs: int = 60, l2: float = 1.0, rate: float = 0.2) -> Model:
    """Maximises the penalised conditional log-likelihood by full-batch AdaGrad; gradients are expected minus seen counts."""
    fx = np.unique(x)
    x = [np.searchsorted(fx, v).astype(np.int32) for v in x.T]  # by kind of feature: nothing has the size of all of them but these
    fc, c = np.unique(c, return_inverse=True)
    own, near, bias, trans = np.zeros(len(fx)), np.zeros((2, len(fc))), 0.0, np.zeros((2, 2))
    start, length = chains(sentence)
    same = np.flatnonzero(sentence[1:] == sentence[:-1])
    t = y.astype(np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (t[same], t[same + 1]), 1)
    hist = [np.full(len(fx), 1e-6), np.full((2, len(fc)), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(epochs):
        p, counts, _ = forward_backward(combine(sum(own[v] for v in x), near[0][c], near[1][c], bias, sentence), trans, start, length)
        d = y - p
        g = [
            sum(np.bincount(v, weights=d, minlength=len(fx)) for v in x) - l2 * 0.01 * own,
            np.stack([np.bincount(c[same], weights=d[same + 1], minlength=len(fc)), np.bincount(c[same + 1], weights=d[same], minlength=len(fc))]) - l2 * 0.1 * near,
            d.sum(),
            seen - counts - l2 * 0.1 * trans,
        ]
        hist = [h + v**2 for h, v in zip(hist, g, strict=True)]
        own, near, bias, trans = (v + rate * d_ / np.sqrt(h) for v, d_, h in zip((own, near, bias, trans), g, hist, strict=True))
    return Model(Weights(fx, own), (Weights(fc, near[0]), Weights(fc, near[1])), float(bias), trans)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: score, toxic (score at least `threshold`), and the toxic tokens' byte spans with their marginals.

    The score is 1 - prod(1 - p) over the tokens with a marginal p of at least the threshold, or the largest p if there is none: smaller ones are
    noise that a long text would add up. A span is a token with a marginal of at least the threshold, as (start, end) in the original UTF-8 bytes. Null and
    empty texts score 0 and have no spans. Repeated rows get equal answers. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            data, off = K.text_of(b.column(1))
            n = b.num_rows
            # Long rows are read in parts that end with a sentence, so no chain is cut.
            cuts, of = K.cut_rows(data, off, lambda d: (d == 10) | (d == 46) | (d == 33) | (d == 63))
            clean, most, spans = np.zeros(n), np.zeros(n), []
            for lo, hi in K.slices(cuts):
                p, t = m.marginals(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
                row = of[lo + t.row]
                np.maximum.at(most, of[lo:hi], -K.row_mins(-p, K.row_starts(t.row, hi - lo), 0))
                hot = np.flatnonzero(p >= threshold)
                clean += np.bincount(row[hot], weights=np.log1p(-np.minimum(p[hot], 1 - 1e-12)), minlength=n)
                base = off[row[hot]] - cuts[lo]
                spans.append((row[hot], (t.start[hot] - base).astype(np.int32), (t.end[hot] - base).astype(np.int32), p[hot].astype(np.float32)))
            row, *found = (np.concatenate(v) for v in zip(*spans, strict=True)) if spans else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32))
            s = np.maximum(1 - np.exp(clean), most)
            edge = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= threshold), *(pa.ListArray.from_arrays(edge, pa.array(v)) for v in found)], names=["doc_id", "score", "toxic", "starts", "ends", "marginals"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)

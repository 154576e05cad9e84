"""Long rows, ties, bounded memory, and the steps that a crash can part."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom.llm import decontaminate, kernels, language, mtree, neardup, quality, sharding, tokencounts, toxicity


def _text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["ab", "é", "  ", "x1 ", "Zed ", "\n", "–", "q", " the ", ". "]) for _ in range(n))


@pytest.mark.parametrize("n, size", [(50, 7), (500, 50), (3000, 300)])
def test_long_rows_in_parts_have_the_features_of_the_whole(n, size):
    data, off = kernels.text_of(pa.array([_text(n, n)]), lower=True)
    whole = np.sort(np.concatenate([h for h, _ in language._grams(data, off)]))
    assert np.array_equal(whole, np.sort(np.concatenate(list(language._in_parts(data, size)))))
    data, off = kernels.text_of(pa.array(["x", _text(n + 1, n), "", "the the the"]))
    row, feature = quality.indicators(data, off)
    parts = [(lo + r, f) for lo, _, r, f in quality.in_parts(data, off, size)]
    assert np.array_equal(np.concatenate([r for r, _ in parts]), row) and np.array_equal(np.concatenate([f for _, f in parts]), feature)


def test_long_spans_and_cuts():
    data = np.frombuffer(b"abcdefghij" * 50, np.uint8)
    start, end = np.array([0, 100, 450]), np.array([90, 440, 455])
    assert np.array_equal(kernels.span_hashes(data, start, end), kernels.span_hashes(data, start, end, block=64))
    text = b"a. b. ccccccccccccccc. d"
    cuts, row = kernels.cut_rows(np.frombuffer(text, np.uint8), np.array([0, 0, 2, len(text)]), lambda d: d == 46, 6)
    assert cuts.tolist() == [0, 0, 2, 5, 22, 24] and row[1:].tolist() == [1, 2, 2, 2]


def _tiles(d, t, least):
    """Greedy string tiling by trying every pair of places again and again."""
    md, mt, out = set(), set(), []
    while True:
        best = None
        for j, i in itertools.product(range(len(t)), range(len(d))):
            n = 0
            while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and i + n not in md and j + n not in mt:
                n += 1
            if n >= least and (best is None or (-n, j, i) < best):
                best = (-n, j, i)
        if best is None:
            return sorted(out)
        n, j, i = -best[0], best[1], best[2]
        out.append((i, j, n))
        md.update(range(i, i + n))
        mt.update(range(j, j + n))


def test_tiles_equal_brute_force_with_ties():
    rng = random.Random(1)
    for _ in range(200):
        k = rng.choice([2, 3, 6])
        d, t = ([rng.randrange(k) for _ in range(rng.randrange(1, n))] for n in (40, 20))
        least = rng.choice([1, 2, 3])
        assert sorted(decontaminate.tile(np.array(d, np.uint64), np.array(t, np.uint64), least)) == _tiles(d, t, least)


def test_repetitive_text_stays_small():
    import tracemalloc

    part = decontaminate.Part.build([1, 2], ["ha " * 200, "ho " * 7], 5)
    data, off = kernels.text_of(pa.array(["ha " * 200_000]))
    tracemalloc.start()
    assert list(part.hits(data, off, 0.5)) == [(0, 0, 200, 1)]
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_indicators_equal_brute_force():
    """Distinct n-grams of tokens and of shapes, counted by hand."""
    words = ["The", "cat", "the", "Cat"]
    data, off = kernels.text_of(pa.array(["The cat", "The cat The cat", "the Cat", ""]))
    row, feature = quality.indicators(data, off)
    by = [set(feature[row == r].tolist()) for r in range(4)]
    # "The cat": 2 words, 1 pair; shapes Xx and xx: 2, and their pair: 6 in all. Twice over adds a pair, a pair of shapes and two triples of shapes.
    assert [len(x) for x in by] == [6, 10, 6, 0] and by[0] < by[1] and len(words) == 4
    # The same two shapes, the other way round: only they are shared.
    assert len(by[0] & by[2]) == 2


def test_votes_equal_brute_force_with_ties():
    names = ["a", "b", "c"]
    pairs = [("f", x, y) for x, y in itertools.combinations(names, 2)]
    m = language.Model({"f": names}, pairs, np.zeros((1 << language.BITS, 3), np.float32), np.zeros(3))
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.normal(size=(200, 3)), [[1, -1, 1], [0, 0, 0], [0.5, -0.5, 0.5]]])
    best, margin = m.vote(s, "f", names)
    for i, row in enumerate(s):
        score = {x: [] for x in names}
        for (_, x, y), v in zip(pairs, row, strict=True):
            score[x].append(v)
            score[y].append(-v)
        want = min(names, key=lambda x: (-sum(v > 0 for v in score[x]), -sum(score[x]), x))
        assert names[best[i]] == want and margin[i] == min(score[want])


def test_quality_score_of_zero_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, " "), (3, None)], "doc_id long, text string")
    model = quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0)
    assert sorted(map(tuple, quality.score(docs, model).collect())) == [(1, 0.0, 0), (1, 0.0, 0), (2, -1.0, 0), (3, -1.0, 0)]


def test_toxic_scores_of_long_rows(spark):
    """A long row in parts scores as its sentences do one by one."""
    weights = toxicity.Weights
    data, off = kernels.text_of(pa.array(["bad"]))
    t, low = toxicity.tokens(data, off)
    own = toxicity.own_features(t, low)[0]
    none = weights(np.empty(0, np.uint32), np.empty(0))
    model = toxicity.Model(weights(own, np.full(len(own), 2.0)), (none, none), -6.0, np.zeros((2, 2)))
    sentences = ["nothing here at all", "this is bad", "fine"]
    long = ". ".join(sentences * 40_000) + "."
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(1, long), (2, sentences[1])], "doc_id long, text string"), model).collect()}
    raw = long.encode()
    assert len(got[1].starts) == 40_000 and {raw[a:b] for a, b in zip(got[1].starts, got[1].ends, strict=True)} == {b"bad"}
    p = got[2].marginals[0]
    assert got[1].toxic and abs(got[1].marginals[7] - p) < 1e-6 and abs(got[2].score - p) < 1e-6


def test_ledger_survives_a_crash_between_two_steps(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * i, "s", "en") for i in range(1, 5)], "doc_id long, text string, source string, lang string")
    counted = tokencounts.count_tokens(docs, {"utf8_bytes": ""}).cache()
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.commit("a", tokencounts.inserts(counted))
    # A writer died while it wrote a marker, and another before it wrote one.
    (tmp_path / "l/commits/.62.torn").write_bytes(b"")
    tokencounts.deltas(tokencounts.inserts(counted)).write.parquet(f"file://{tmp_path}/l/deltas/lost")
    assert ledger.committed() == {"a"} and ledger.totals().first().docs == 4
    assert not ledger.commit("a", tokencounts.inserts(counted)) and ledger.commit("b", tokencounts.deletes(counted.where("doc_id = 1")))
    assert not ledger._appear(["x"], "commits", b"b".hex())
    assert ledger.totals().first().docs == 3


def test_totals_from_a_snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencounts, "COMPACT", 3)
    docs = spark.createDataFrame([(1, "w w", "s", "en"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    counted = tokencounts.count_tokens(docs, {"utf8_bytes": ""}).cache()
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/l")
    for i in range(5):
        assert ledger.commit(f"b{i}", tokencounts.inserts(counted))
    folder, names, covered = ledger._since()
    assert folder and len(names) == 2 and len(covered) == 3
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == [("s", "en", "utf8_bytes", 5, 15), (None, None, "utf8_bytes", 5, 0)]
    assert not ledger.commit("b0", tokencounts.inserts(counted))
    # Of a thousand markers only those after the snapshot are read.
    for i in range(1000):
        ledger._appear(["nowhere"], "commits", f"x{i}".encode().hex())
    ledger._appear([folder, *ledger._list("commits")], "snapshots", f"{2000:012d}")
    assert ledger._since()[1] == [] and ledger.totals().count() == 2


def test_sharding_in_cells_loses_little_balance(spark):
    rng = np.random.default_rng(5)
    groups = spark.createDataFrame([(int(i), int(w)) for i, w in enumerate((rng.pareto(1.5, 3000) * 500 + 1).astype(int))] + [(10_000 + i, 700) for i in range(50)], "grp long, bytes long")

    def spread(cell):
        s = [r.s for r in sharding.assign(groups, 8, cell).groupBy("shard").agg(F.sum("bytes").alias("s")).collect()]
        return (max(s) - min(s)) / sum(s) * len(s)

    one, many = spread(10_000), spread(300)
    assert one < 0.001 and many < 0.001


def test_equal_vectors_and_clashing_names(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)], i, "x") for i in range(40)], "vec_id long, embedding array<float>, id long, v string")
    got = mtree.top_k(rows, 3).where("vec_id = 7").orderBy("rank").collect()
    assert [(r.neighbor_id, r.distance) for r in got] == [(1, 0.0), (3, 0.0), (5, 0.0)]


def test_copies_in_one_hot_bucket(spark):
    """A group of copies and near copies, with other columns named like the operator's own."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i % 3 else base + f" tail{i % 5}", i, "x") for i in range(120)] + [(1000, "something else entirely here", 0, "y"), (1001, None, 0, None), (None, base, 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, band string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 120 and {r.kept_id for r in got} == {None}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1000, 1001, None]

"""The methods against brute force, exact round trips and held-out accuracy."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom.llm import bundles, decontaminate, language, mtree, neardup, quality, sentencepieces, sharding, svm, tokencounts, toxicity
from changeloom.llm import kernels as K
from changeloom.llm.common import table
from changeloom.llm.components import connected
from changeloom.llm.queries import OP6_SQL

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"\w+", (t or "").lower())


# --- kernels -----------------------------------------------------------------

def test_runs_and_ngrams():
    texts = ["a bb, a", "", "bb", "x" * 3000 + " bb", None, "été ÉTÉ"]
    data, off = K.text_of(pa.array(texts), lower=True)
    r = K.Runs(data, off, words_only=True)
    got = [[bytes(data[a:b]).decode() for a, b, w in zip(r.start, r.end, r.row, strict=True) if w == i] for i in range(6)]
    assert got == [["a", "bb", "a"], [], ["bb"], ["x" * 3000, "bb"], [], ["été", "été"]]
    assert r.hash[0] == r.hash[2] and r.hash[1] == r.hash[3] == r.hash[5] and len(set(r.hash.tolist())) == 4
    assert K.ngrams(r.hash, r.row, 2)[1].tolist() == [0, 0, 3, 5]


# --- 1 -----------------------------------------------------------------------

def brute_tiles(a, b, seed):
    """Greedy string tiling by its definition: again and again the longest run of unmarked equal words, first in b, then in a."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= seed and (best is None or n > best[0]):
                    best = (n, j, i)
        if best is None:
            return total
        n, j, i = best
        for k in range(n):
            ma[i + k] = mb[j + k] = True
        total += n


def test_tiling_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randrange(5, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(5, 25))]
        part = decontaminate.Part.build([7], [" ".join(b)], 3)
        data, off = K.text_of(pa.array([" ".join(a)]))
        got = list(part.hits(data, off, 0.0))
        assert (got[0][2] if got else 0) == brute_tiles(a, b, 3)


def test_reordered_passage_and_op1(spark):
    item = " ".join(f"w{i}" for i in range(40))
    parts = item.split()
    moved = " ".join(["x"] * 9 + parts[20:] + ["filler"] * 30 + parts[:20])
    docs = spark.createDataFrame([(1, moved), (2, " ".join(parts[:12])), (3, " ".join(parts[:25]).upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {(r.doc_id, r.covered, r.tiles) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 40, 2), (3, 25, 1)}
    whole = decontaminate.contaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark"))
    split = decontaminate.contaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark"), part_words=300)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))


def test_short_items_match_in_full(spark):
    docs = spark.createDataFrame([(1, "Yes, of course!"), (2, "He said: yes, of course he did, yes of course."), (3, "yes of"), (4, "of course yes"), (5, "unique")], "doc_id long, text string")
    long = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(10, long), (11, "yes of course"), (12, "unique"), (13, "!!!"), (14, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.covered, r.item_words, r.tiles) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 11, 3, 3, 1), (2, 11, 3, 3, 1), (5, 12, 1, 1, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4]


# --- 2 and 7 -----------------------------------------------------------------

def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 * rng.normal(size=80) > 0, 1, -1)
    w, b = svm.fit_dual(np.arange(0, 401, 5), np.tile(np.arange(5), 80), x.ravel(), y, 5, c=1.0, epochs=3000, tol=1e-8, balance=False)
    def objective(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = objective(w, b)
    for _ in range(300):
        assert objective(w + 0.02 * rng.normal(size=5), b + 0.02 * rng.normal()) >= best - 1e-6


def test_quality_held_out(spark):
    docs, lab = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    train, rest = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1")
    r = quality.score(docs, quality.fit(docs, train)).join(rest, "doc_id")
    assert r.where("quality = quality_pred").count() / r.count() > 0.98


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    m = language.fit(docs.where("doc_id % 2 = 0"), per_language=300)
    assert m.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert [p[0] for p in m.pairs] == ["", "germanic", "romance"]
    r = language.identify(docs.where("doc_id % 2 = 1"), m)
    n = r.count()
    assert r.where("lang = lang_pred").count() / n > 0.98 and r.where("accepted").count() / n > 0.995


# --- 3 -----------------------------------------------------------------------

def test_pieces_match_the_library_and_spans_hold():
    import sentencepiece as spm

    c = sentencepieces.Codec()
    sp = spm.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    texts = ["The cat sat.", "", " ", "  a  b ", "a\nb  c", "日本 語😀 é", "naïve café — ok", " lead", "trail ", "x", "\t tab"]
    data, off = K.text_of(pa.array(texts))
    ids, starts, ends, at = c.encode_batch(data, off)
    for i, t in enumerate(texts):
        s = slice(at[i], at[i + 1])
        assert ids[s].tolist() == sp.encode(t)
        assert c.decode(ids[s]).decode() == t
        raw, cuts = t.encode(), list(zip(starts[s].tolist(), ends[s].tolist(), strict=True))
        assert b"".join(raw[a:b] for a, b in cuts) == raw
        one = c.encode(raw)
        assert all(np.array_equal(x, y) for x, y in zip(one, (ids[s], starts[s], ends[s]), strict=True))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_map_matches_the_library(rule):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = spm.SentencePieceNormalizer(rule_name=rule)
    m = pb.ModelProto()
    m.ParseFromString(lib.serialized_model_proto())
    mine = sentencepieces.Normalizer(m.normalizer_spec)
    rng = random.Random(3)
    pool = "abc  XYZ é①ﬁⅧ ｱｲｳﾞ ㍿ ＡＢＣ\t\n　 ́é한글각한日本 😀​½ß"
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        out, align = mine(t.encode())
        text, chars = lib.normalize(t, with_offsets=True)
        assert out.decode() == text
        if text:
            raw, at = t.encode(), 0
            for ch, want in zip(text, chars, strict=False):
                assert len(raw[: align[at]].decode()) == want
                at += len(ch.encode())


# --- 4 -----------------------------------------------------------------------

def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        e, t = rng.normal(size=n), rng.normal(size=(2, 2))
        p, counts, logz = toxicity.forward_backward(e, t, np.array([0]), np.array([n]))
        z, marg, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            z += w
            marg += w * np.array(y)
            for i in range(n - 1):
                pair[y[i], y[i + 1]] += w
        assert np.allclose(p, marg / z) and np.allclose(counts, pair / z) and np.isclose(logz, np.log(z))


def test_a_long_sentence_is_one_chain():
    data, off = K.text_of(pa.array([" ".join(f"w{i}" for i in range(300)) + ". One more.", "x"]))
    t, _ = toxicity.tokens(data, off)
    assert np.bincount(t.sentence).tolist() == [300, 2, 1]
    rng = np.random.default_rng(3)
    start, length = np.array([70, 0, 370, 435]), np.array([300, 70, 65, 1])
    e, t = rng.normal(size=436), rng.normal(size=(2, 2)) * 2
    p, counts, logz = toxicity.forward_backward(e, t, start, length)
    total, pairs = 0.0, np.zeros((2, 2))
    for s, n in zip(start, length, strict=True):
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0, 1] = e[s]
        for k in range(1, n):
            a[k] = [np.logaddexp(*(a[k - 1] + t[:, c])) + c * e[s + k] for c in (0, 1)]
        for k in range(n - 2, -1, -1):
            b[k] = [np.logaddexp(*(t[c] + b[k + 1] + [0, e[s + k + 1]])) for c in (0, 1)]
        z = np.logaddexp(*a[-1])
        total += z
        assert np.allclose(p[s : s + n], np.exp(a + b - z)[:, 1])
        for k in range(1, n):
            pairs += np.exp(a[k - 1][:, None] + t + b[k] + [0, e[s + k]] - z)
    assert np.isclose(logz, total) and np.allclose(counts, pairs)


def test_toxic_spans(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "pe", "di", "fu", "go")]
    rows, lab = [], []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = "grubbel" + rng.choice(["", "ing", "ed", "son"])
        rows.append((i, " ".join(w).capitalize() + "."))
        lab.append((i, int(bad)))
    rows += [(1000, "Kana loso grubbelous mipe."), (1001, "Kana loso mipe.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(lab, "doc_id long, toxic int")), threshold=0.5).collect()}
    assert all(r[i].toxic == (i % 4 == 0) for i in range(400))
    assert r[1000].toxic and rows[400][1][r[1000].starts[0] : r[1000].ends[0]] == "grubbelous" and not r[1001].toxic

def test_toxic_words_are_counted_over_all_labelled_documents(spark):
    rng = random.Random(14)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "pe", "di", "fu", "go")]
    rows, lab = [], []
    for i in range(1600):
        w = [rng.choice(vocab) for _ in range(30)]
        if i % 2:
            w[rng.randrange(30)] = "zorgle" if i % 40 == 1 else "grubbel"  # the rare word is in 1 of 20 toxic documents
        rows.append((i, " ".join(w) + "."))
        lab.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame(lab, "doc_id long, toxic int"), rows=120)  # about 6 of the sampled documents have it
    r = {x.doc_id: x.toxic for x in toxicity.score(docs, m, threshold=0.5).collect()}
    assert all(r[i] == bool(i % 2) for i in range(1600))


# --- 5 -----------------------------------------------------------------------

def test_differencing():
    rng = np.random.default_rng(1)
    s, slot = sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(s.tolist()) == [14, 16]  # the textbook's example
    for n, k in ((5, 2), (40, 3), (200, 7), (3, 8), (64, 64), (1, 4)):
        w = rng.integers(0, 1000, n)
        order = np.argsort(-w, kind="stable")
        full = np.zeros((n, k), np.int64)
        full[:, 0] = w[order]
        s1, m1 = sharding.difference(full)
        s2, m2 = sharding.difference_weights(w, k)
        assert sorted(s1) == sorted(s2)
        assert sorted(np.bincount(m1[:, 0], weights=w[order], minlength=k)) == sorted(s1)
        assert sorted(np.bincount(m2, weights=w, minlength=k)) == sorted(s2)


def test_shards_over_levels(spark):
    docs = table(spark, SF, "documents")
    size = docs.select("doc_id", "text", F.octet_length("text").alias("b"))
    for cell in (20_000, 150):
        r = sharding.shard_documents(docs, 8, cell).join(size, "doc_id")
        assert r.count() == docs.count()
        b = [x.s for x in r.groupBy("shard").agg(F.sum("b").alias("s")).collect()]
        assert len(b) == 8 and max(b) < 1.01 * sum(b) / 8
        assert r.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


# --- 6 -----------------------------------------------------------------------

@pytest.mark.parametrize("every", [1, 50])
@pytest.mark.parametrize("cell", [4096, 60])
def test_top_k_matches_sql(spark, cell, every):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert OP6_SQL.count("a.vec_id % 50 = 0") == 1
    want = {tuple(r) for r in con.sql(OP6_SQL.replace("a.vec_id % 50 = 0", f"a.vec_id % {every} = 0")).fetchall()}
    assert len(want) == 10 * len(range(0, con.sql("select count(*) from embeddings").fetchall()[0][0], every))
    got = mtree.top_k(table(spark, SF, "embeddings"), cell=cell, every=every).withColumn("distance", F.round("distance", 4))
    assert {tuple(r) for r in got.collect()} == want


def test_trees_are_stored_once(spark, monkeypatch, tmp_path):
    """Queries in many parts meet the same stored trees; a cell that is too large for one tree gets several."""
    import pickle

    monkeypatch.setattr(mtree, "TREE", 150 * 4 * 64)
    monkeypatch.setattr(mtree, "PART", 60 * (4 * 64 + 16 * 10 + 16))
    monkeypatch.setattr(mtree, "work_dir", lambda spark, what: f"file:{tmp_path}/{what}")
    vectors = table(spark, SF, "embeddings")
    got = {(r.vec_id, r["rank"]): r.neighbor_id for r in mtree.top_k(vectors).collect()}
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    for i, v in enumerate(x):
        d = mtree.exact(np.broadcast_to(v, x.shape), x)
        d[i] = np.inf
        assert [got[int(ids[i]), r] for r in range(1, 11)] == ids[np.lexsort((ids, d))[:10]].tolist()
    trees = [pickle.loads(p.read_bytes()) for p in (tmp_path / "mtree" / "trees").iterdir() if p.suffix != ".crc"]
    assert len(trees) > 2 and len(list((tmp_path / "mtree" / "found").iterdir())) > 2
    assert sorted(int(i) for t in trees for page in mtree.leaves(t) for i in page) == ids.tolist()


@pytest.mark.parametrize("kind", ["far from zero", "huge", "tiny", "of all sizes", "ties", "one vector"])
def test_rounding_loses_no_neighbour(kind):
    rng = np.random.default_rng(1)
    x = {
        "far from zero": rng.normal(size=(3000, 16)) * 1e-3 + 1000,
        "huge": rng.normal(size=(3000, 8)) * 1e30,
        "tiny": rng.normal(size=(3000, 8)) * 1e-30,
        "of all sizes": rng.normal(size=(3000, 8)) * 10.0 ** rng.integers(-20, 20, size=(3000, 1)),
        "ties": rng.integers(0, 3, size=(3000, 4)),
        "one vector": np.ones((3000, 4)),
    }[kind].astype(np.float32).astype(np.float64)  # values that both kinds of float hold
    ids, at = rng.permutation(len(x)), np.arange(0, len(x), 50)
    parent = x[0].astype(np.float64)
    qi, nid, d = mtree.search(mtree.build(ids, x, parent), parent, ids[at], x[at], 5)
    for n, i in enumerate(at):
        full = mtree.exact(np.broadcast_to(x[i], x.shape), x)
        full[i] = np.inf
        want = np.lexsort((ids, full))[:5]
        assert nid[qi == n].tolist() == ids[want].tolist() and d[qi == n].tolist() == full[want].tolist()


def test_bounds_avoid_distances():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, size=(300, 3)) for c in range(0, 40, 2)])
    ids = np.arange(len(x))
    root = mtree.build(ids, x, x.mean(0), page=32)
    stats: dict = {}
    qi, nid, d = mtree.search(root, x.mean(0), ids[:32], x[:32], 5, stats=stats)
    full = np.sqrt(((x[:32, None] - x[None]) ** 2).sum(-1))
    full[np.arange(32), np.arange(32)] = np.inf
    assert np.array_equal(nid.reshape(32, 5), np.argsort(full, 1, kind="stable")[:, :5])
    assert stats["computed"] < 0.3 * 32 * len(x)


# --- 8 -----------------------------------------------------------------------

def test_counts_match_the_tokenizer(spark, tmp_path):
    import base64

    import tiktoken

    with open(tokencounts.TOKENIZERS["byte_bpe_50k"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r.text for r in docs.collect()] + ["", " ", "a", "  a b", "a \n b", "a  b", " x", "x ", "\n\n x \t y", "日本 語 é", "　 b", "it's  we'll"]
    data, off = K.text_of(pa.array(texts))
    assert tokencounts.Counter(tokencounts.TOKENIZERS["byte_bpe_50k"])(data, off).tolist() == [len(e.encode_ordinary(t)) for t in texts]
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/l")
    ledger.commit("x", tokencounts.inserts(tokencounts.count_tokens(docs)))
    ledger.commit("y", tokencounts.deletes(tokencounts.count_tokens(docs.where("doc_id % 3 = 0"))))
    want: dict = {}
    for r in docs.where("doc_id % 3 != 0").collect():
        for name, n in (("byte_bpe_50k", len(e.encode_ordinary(r.text))), ("utf8_bytes", len(r.text.encode()))):
            a = want.setdefault((r.source, r.lang, name), [0, 0])
            a[0] += 1
            a[1] += n
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in ledger.totals().collect()} == want


# --- 9 -----------------------------------------------------------------------

def test_bundle_format(spark, tmp_path):
    import zstandard

    pages = table(spark, SF, "pages")
    bundles.bundle(pages, f"{tmp_path}/b", frame=32 << 10, bundle_bytes=400_000).write.parquet(f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i").collect()
    want = {r.page_id: r for r in pages.collect()}
    assert {r.page_id for r in index} == set(want) and len({r.bundle for r in index}) > 1
    for name in {r.bundle for r in index}:
        path = name.removeprefix("file://")
        with open(path, "rb") as f:
            frames = bundles.seek_table(f)
            f.seek(frames[-1][0] + frames[-1][1])
            assert struct.unpack("<I", f.read(4))[0] == bundles.SKIPPABLE
            for r in (x for x in index if x.bundle == name):
                assert frames[r.frame][:2] == (r.frame_start, r.frame_size)
                fields, body = bundles.parse(bundles.read_record(f, r.frame_start, r.frame_size, r.offset, r.length))
                assert body.decode() == want[r.page_id].html and fields["WARC-Target-URI"] == want[r.page_id].url
        with open(path, "rb") as f:  # a plain decoder reads the whole file
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().count(b"WARC/1.1\r\n") >= len([x for x in index if x.bundle == name])


# --- 10 ----------------------------------------------------------------------

def test_sketches():
    a, b = np.arange(0, 3000, dtype=np.uint64), np.arange(1000, 4000, dtype=np.uint64)
    reg = lambda x: neardup.registers(K.mix(x + np.uint64(99)), np.array([0, len(x)]))
    ra, rb, ru = reg(a), reg(b), reg(np.union1d(a, b))
    assert np.array_equal(neardup.merge(ra, rb), ru)
    assert abs(neardup.cardinality(ra)[0] / 3000 - 1) < 0.3
    assert abs(neardup.joint(ra, rb)[0] - 0.5) < 0.15 and neardup.joint(ra, ra)[0] > 0.98


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    used = {v for e in edges for v in e}
    got = {r.id: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in used if find(v) != v}


def test_groups_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    at: dict = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    both: dict = {}
    for ids in at.values():
        for j, b in enumerate(ids):
            for a in ids[:j]:
                both[a, b] = both.get((a, b), 0) + 1
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= neardup.THRESHOLD:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {(i, find(i)) for i in sets if find(i) != i}
    got = {(r.doc_id, r.kept_id) for r in neardup.near_duplicates(docs).collect()}
    assert len(want & got) >= 0.95 * len(want) and not got - want


def test_copies_without_words_are_collapsed(spark):
    rows = [(1, "-----"), (2, "-----"), (3, "!!! ###"), (4, "!!! ##"), (5, "!!! ###"), (6, ""), (7, ""), (8, None), (9, None), (10, "a -----")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.kept_id) for r in neardup.near_duplicates(docs).collect()} == {(2, 1), (5, 3)}
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [1, 3, 4, 6, 7, 8, 9, 10]

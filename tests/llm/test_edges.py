"""Every operator and every pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeloom.llm import bundles, decontaminate, language, mtree, neardup, quality, sentencepieces, sharding, tokencounts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t int, score double, e1 array<int>, root map<string,int>"
EN = "the cat sat on the mat and looked at the other cat while it was raining over there in the garden"
DE = "der Hund und die Katze sind nicht auf dem Dach aber sie waren gestern noch in der Stadt und im Garten"
FR = "le chat est sur la table avec une souris dans la maison et les enfants sont pour le jardin"
ES = "el gato esta en la mesa con los ratones para la casa y las flores del jardin que no son de ellos"


def documents(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base, lang = ((EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es"))[i % 4]
        words = base.split()
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ". " + " ".join(f"{rng.choice(words)}{j}x" for j in range(30)), lang))
    rows += [(100, None, "en"), (101, "", "en"), (102, "   \n\t ", None), (103, "!!! ??? ...", "en"), (104, "é", "fr"), (None, EN, "en"), (105, "word " * 60_000, "en"), (106, rows[0][1], "en"), (0, rows[0][1], "en"), (0, rows[0][1], "en"), (107, "日本 語 😀 ▁x", "xx")]
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), "clash", 1, 2.0, [1], {"a": 1}) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(40)]
    return spark.createDataFrame([*rows, (None, 1, 1), (41, None, None), (3, 1, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, EN), (2, None), (3, ""), (4, "two words"), (1, EN), (None, DE)], "item_id long, text string")


def test_language(spark, docs, empty):
    m = language.fit(docs)
    r = {(x.doc_id): x for x in language.identify(docs, m).collect()}
    assert language.identify(docs, m).count() == docs.count()
    for i in (100, 101, 102, 103):
        assert (r[i].lang_pred, r[i].family, r[i].margin, r[i].accepted) == ("und", "und", 0, False)
    assert language.identify(empty, m).count() == 0
    none = language.fit(empty)
    assert {x.lang_pred for x in language.identify(docs, none).collect()} == {"und"}
    kept = language.keep_identified(docs, m)
    assert kept.columns == docs.columns and kept.where("doc_id in (100, 101, 102, 103)").count() == 0


def test_quality(spark, docs, empty):
    m = quality.fit(docs, labels(spark))
    r = quality.score(docs, m).collect()
    assert len(r) == docs.count()
    assert {(x.score, x.quality_pred) for x in r if x.doc_id in (100, 101, 102)} == {(-1.0, 0)}
    assert quality.score(empty, quality.fit(empty, labels(spark))).count() == 0
    assert quality.keep_good(docs, quality.fit(empty, labels(spark))).where("doc_id = 105").count() == 1  # nothing to learn from: all with a token stay
    assert quality.keep_good(docs, m).columns == docs.columns


def test_toxicity(spark, docs, empty):
    m = toxicity.fit(docs, labels(spark))
    r = toxicity.score(docs, m).collect()
    assert len(r) == docs.count()
    assert {x.score for x in r if x.doc_id in (100, 101, 102, 103)} == {0.0}
    assert toxicity.score(empty, m).count() == 0
    assert not any(x.toxic for x in toxicity.score(docs, toxicity.fit(empty, labels(spark))).collect())


def test_near_duplicates(spark, docs, empty):
    r = sorted((x.doc_id, x.kept_id) for x in neardup.near_duplicates(docs).collect())
    assert r == [(0, 0), (0, 0), (106, 0)]
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id in (100, 101, 102, 103)").count() == 4
    assert neardup.keep_one(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    r = decontaminate.contaminated(docs, benchmark(spark)).collect()
    assert sorted((x.doc_id is None, x.item_id) for x in r if x.coverage == 1) == [(True, 1), (True, 1)]
    assert decontaminate.contaminated(empty, benchmark(spark)).count() == 0
    assert decontaminate.contaminated(docs, benchmark(spark).where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark(spark)).where("doc_id is null").count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark(spark), part_words=5).columns == docs.columns


def test_sentencepiece(spark, docs, empty):
    r = sentencepieces.encode(docs).collect()
    assert len(r) == docs.count()
    by = {x.doc_id: x for x in r}
    assert by[100].ids is None and by[100].round_trip is None and by[101].ids == [] and by[101].round_trip
    assert by[102].round_trip and by[105].round_trip and not by[107].round_trip  # a literal mark becomes a space
    assert sentencepieces.encode(empty).count() == 0
    back = {x.doc_id: x.text for x in sentencepieces.decode(sentencepieces.encode(docs)).collect()}
    assert back[100] is None and back[101] == "" and back[105] == "word " * 60_000


def test_sharding(spark, docs, empty):
    r = sharding.shard_documents(docs, shards=4).collect()
    assert len(r) == docs.count() and {x.shard for x in r} <= {0, 1, 2, 3}
    assert len({x.shard for x in r if x.doc_id in (0, 106)}) == 1
    assert sharding.shard_documents(empty, shards=4).count() == 0
    assert {x.shard for x in sharding.shard_documents(docs, shards=1).collect()} == {0}


def test_token_counts(spark, docs, empty, tmp_path):
    d = docs.withColumn("source", F.when(F.col("doc_id") == 104, None).otherwise("s"))
    c = tokencounts.count_tokens(d).cache()
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.totals().count() == 0
    assert ledger.commit("a", tokencounts.inserts(c)) and not ledger.commit("a", tokencounts.inserts(c))
    once = {tuple(x) for x in ledger.totals().collect()}
    assert ledger.commit("b", tokencounts.deletes(c)) and ledger.totals().count() == 0
    assert ledger.commit("c", tokencounts.inserts(c)) and {tuple(x) for x in ledger.totals().collect()} == once
    assert ledger.commit("e", tokencounts.inserts(tokencounts.count_tokens(empty))) and {tuple(x) for x in ledger.totals().collect()} == once
    assert ledger.commit("r", tokencounts.revisions(c.where("doc_id = 106"), c.where("doc_id = 106")))  # a revision without a change


def test_bundles(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (None, None, None, 1), (2, "x\ny", "", 1), (3, "u", "é" * 400_000, 1), (1, "u", "<p>a</p>", 1)], "page_id long, url string, html string, frame int")
    bundles.bundle(pages, f"{tmp_path}/b").write.parquet(f"{tmp_path}/i")
    got = bundles.fetch(spark.read.parquet(f"{tmp_path}/i")).collect()
    assert len(got) == 5 and all(x.intact for x in got)
    assert sorted((x.page_id or -1, len(x.html)) for x in got) == [(-1, 0), (1, 8), (1, 8), (2, 0), (3, 400_000)]
    assert bundles.bundle(pages.where("false"), f"{tmp_path}/e").count() == 0


def test_top_k(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 0.0]), (None, [0.0, 0.0]), (2, [1.0, 0.0]), (8, [1.0, 0.0])]
    v = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, cell int")
    got = {(x.vec_id, x.rank): x.neighbor_id for x in mtree.top_k(v, k=2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 8, (2, 2): 1, (3, 1): 1, (3, 2): 2, (8, 1): 2, (8, 2): 1}
    assert mtree.top_k(v.where("false")).count() == 0 and mtree.top_k(v.where("vec_id = 1")).count() == 0


def test_stages(spark, docs, empty, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (docs, empty):
        left = d
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, left, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == d.columns, name
            assert out.count() <= left.count()
            left = out.cache()

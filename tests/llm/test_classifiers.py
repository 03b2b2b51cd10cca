import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, toxicity
from tessella.llm.common import letter_words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(tables):
    return toxicity.train_toxicity(*tables)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.97
    assert np.mean((s >= 0.5)[y == 0]) < 0.01 and np.mean((s >= 0.5)[y == 1]) > 0.8


def scalar_score(model, text):
    found = {g for w in letter_words(text) for g in toxicity.grams(w)} & model.weights.keys()
    return 1 / (1 + np.exp(-(model.intercept + sum(model.weights[g] for g in found))))


def test_toxicity_scores_whole_texts(tables, toxic_model):
    docs, _ = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, toxic_model).collect():
        assert r["score"] == pytest.approx(scalar_score(toxic_model, texts[r["doc_id"]]))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    late = "word " * 5000 + "idiot moron worthless"
    assert toxic_model.score(late) > toxic_model.score("word " * 5000)


def test_toxicity_never_learns_held_out_labels(tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train_toxicity(docs, x) for x in (labels, flipped))
    assert a.weights == b.weights and a.intercept == b.intercept


def test_toxicity_hard(spark, hard, empty, toxic_model):
    rows = toxicity.score_toxicity(hard, toxic_model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.score_toxicity(empty, toxic_model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train_toxicity(hard, none).score("anything") == 0
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.train_toxicity(hard, one, hold_out=None).score("anything") == pytest.approx(1)


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    rows = [sorted(rng.choice(6, 3, replace=False).tolist()) for _ in range(80)]
    y = np.array([float(0 in r or rng.random() < 0.2) for r in rows])
    share = np.full(80, 1 / 80)
    scale = np.ones(6)
    w, b = toxicity._logistic(rows, scale, y, share, 1e-2, 3000)
    z = np.array([w[r].sum() + b for r in rows])
    g = share * (1 / (1 + np.exp(-z)) - y)
    grad = np.array([sum(g[i] for i, r in enumerate(rows) if j in r) for j in range(6)]) + 1e-2 * w
    assert abs(grad).max() < 1e-4 and abs(g.sum()) < 1e-4


@pytest.fixture(scope="module")
def lang_model(tables):
    return langid.train_languages(tables[0])


def test_languages_held_out(tables, lang_model):
    rows = langid.identify_languages(tables[0], lang_model).join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in held]) < 0.1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_languages_against_dense_cosine(lang_model):
    texts = ["the and of this that", "der die das und ist", "zzz qqq"]
    for text, (lang, score, _) in zip(texts, lang_model.classify(texts), strict=True):
        tf = Counter(g for w, n in Counter(letter_words(text)).items() for _ in range(n) for g in langid.grams(w))
        v = np.zeros(len(lang_model.vocabulary))
        for g, n in tf.items():
            if g in lang_model.vocabulary:
                v[lang_model.vocabulary[g]] = np.log1p(n) * lang_model.idf[lang_model.vocabulary[g]]
        sims = lang_model.centroids @ (v / np.linalg.norm(v))
        assert lang == lang_model.languages[lang_model.owner[int(sims.argmax())]]
        assert score == pytest.approx(float(sims.max()), abs=1e-5)


def test_rejection_of_foreign_text(lang_model):
    (_, score, rejected), (_, zero, unknown) = lang_model.classify(["xqzk wvxj kkqz zzxq jjwv qqkx", "漢字"])
    assert rejected and unknown and zero == 0 and score < 0.6


def test_several_centroids(lang_model):
    assert all((lang_model.owner == i).sum() >= 2 for i in range(len(lang_model.languages)))


def test_languages_hard(hard, empty, lang_model):
    by = {r["doc_id"]: r for r in langid.identify_languages(hard, lang_model).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 10))
    assert by[1]["lang_pred"] in lang_model.languages
    assert langid.identify_languages(empty, lang_model).count() == 0
    nothing = langid.train_languages(empty)
    assert {r["lang_pred"] for r in langid.identify_languages(hard, nothing).collect()} == {"und"}


def test_languages_ignore_the_fold(tables):
    docs = tables[0]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.train_languages(docs), langid.train_languages(other)
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids)

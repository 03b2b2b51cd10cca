import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import phrases, terms
from tessella.operators import lexical

WORDS = ["expense", "Expenses", "policy", "in", "inner", "体验", "治理", "体验治理的目标", "客户体验", "ok_1", "K", "İstanbul", "a", "的", "straße", "x1"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    text = lambda n: rng.choice([" ", "，", ""]).join(rng.choices(WORDS, k=n))
    rows = [(f"c{i}", text(rng.randrange(12)), text(rng.randrange(3)), rng.choice(["policy.md", "体验.md", "a/in.txt"]), rng.choice(["en", "zh"])) for i in range(60)]
    return spark.createDataFrame(rows, "chunk_id string, content string, heading_path string, source string, lang string")


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    rows = [(f"q{i}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))) for i in range(12)]
    return spark.createDataFrame([*rows, ("none", "ense"), ("blank", "？ 。"), ("absent", "zzz yyy")], "query_id string, query string")


def plain_search(corpus, queries, conditions):
    """Every chunk against every query with the two boost expressions, as the definition says."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text = corpus.select("chunk_id", "lang", low("content").alias("c"), low("heading_path").alias("h"), low("source").alias("s"))
    asked = queries.select("query_id", terms("query").alias("qt"), phrases("query").alias("qp"))
    boost = lexical.phrase_boost(F.col("qp"), F.col("c"), F.col("h"), F.col("s")) + lexical.metadata_boost(F.col("qt"), terms("h"), terms("s"))
    phrased = F.exists("qp", lambda p: F.contains("c", p) | F.contains("h", p) | F.contains("s", p))
    bm25 = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in lexical.bm25_scores(lexical.build_index(corpus), lexical.query_terms(queries)).collect()}
    known, out = {q for q, _ in bm25}, {}
    for r in text.crossJoin(asked).withColumn("boost", boost).withColumn("phrased", phrased).collect():
        pair = (r["query_id"], r["chunk_id"])
        if conditions and r["lang"] != conditions["lang"]:
            continue
        if pair in bm25 or (r["query_id"] not in known and r["phrased"]):
            score = bm25.get(pair, 0.0) + r["boost"]
            if score > 0:
                out[pair] = score
    return out


@pytest.mark.parametrize("conditions", [None, {"lang": "en"}])
def test_search_equals_the_definition(spark, corpus, queries, conditions):
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.lexical_search(corpus, queries, 1000, conditions).collect()}
    want = plain_search(corpus, queries, conditions)
    assert got == pytest.approx(want) and any(q == "none" for q, _ in want)


def test_many_queries_are_not_broadcast(spark, corpus, queries, monkeypatch):
    want = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.lexical_search(corpus, queries, 1000).collect()}
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.lexical_search(corpus, queries, 1000).collect()}
    assert got == pytest.approx(want)


def test_no_text_is_joined_to_queries(corpus, queries):
    plan = lexical.lexical_search(corpus, queries, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" not in plan.lower()


def test_phrases_in_runs(spark):
    runs = spark.createDataFrame([("expenses",), ("体验治理的目标",), ("ok_1",)], "run string")
    wanted = spark.createDataFrame([("expense",), ("ense",), ("治理的",), ("zz",), ("ok_1",), ("expensesx",)], "p string")
    got = {tuple(r) for r in lexical.phrases_in_runs(runs, wanted).collect()}
    assert got == {("expenses", "expense"), ("expenses", "ense"), ("体验治理的目标", "治理的"), ("ok_1", "ok_1")}
    assert lexical.phrases_in_runs(runs, wanted.limit(0)).count() == 0


def test_a_stored_index_is_kept_up(spark, corpus, queries, tmp_path):
    wanted = lexical.query_terms(queries)
    first = str(tmp_path / "first")
    lexical.store_index(lexical.build_index(corpus), first)
    changed = spark.createDataFrame([("c0", "expense policy 体验治理"), ("new", "policy in in")], "chunk_id string, content string")
    removed = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    second = str(tmp_path / "second")
    lexical.store_index(lexical.update_index(lexical.load_index(spark, first), changed, removed), second)
    whole = corpus.select("chunk_id", "content").filter("chunk_id not in ('c0', 'c1', 'c2')").unionByName(changed)
    score = lambda index: {(r["query_id"], r["chunk_id"]): r["bm25"] for r in lexical.bm25_scores(index, wanted).collect()}
    assert score(lexical.load_index(spark, second)) == pytest.approx(score(lexical.build_index(whole)))
    assert score(lexical.load_index(spark, first)) == pytest.approx({(r["query_id"], r["chunk_id"]): r["bm25"] for r in lexical.bm25_search(corpus, queries).collect()})

import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import best, lexical, rerank
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held", [1 << 18, 10])
@pytest.mark.parametrize("words", [False, True])
def test_best_keeps_what_ranks_first(held, words, monkeypatch):
    monkeypatch.setattr(best, "HELD", held)
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.integers(0, 40, (5, 300)) / 40, np.ones((1, 300)), rng.random((1, 300)) * 1e-7])
    ids = rng.permutation(300)
    names = pa.array([f"c{i:03}" for i in ids]) if words else pa.array(ids)
    kept = best.Best(7, 4, 1e-5)
    for a in range(0, 300, 37):
        for q in (np.array([0, 1, 2]), np.array([3, 4, 5, 6])):
            kept.add(q, names[a : a + 37], score[q, a : a + 37])
    query, chunk, got = kept.cut()
    rows = list(zip(query.tolist(), chunk.to_pylist(), got.tolist()))
    assert len(rows) == len(set(rows)) and sum(q == 5 for q, _, _ in rows) == 4
    for q in range(7):
        want = sorted(zip((-score[q]).round(6).tolist(), names.to_pylist()))[:4]
        assert sorted((-round(s, 6), c) for k, c, s in rows if k == q)[:4] == want


def test_tokens_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 8))]
    asked, chunks = {f"q{i}": unit(1 + i % 3) for i in range(7)}, {i: unit(1 + i % 5) for i in range(40)}
    queries = spark.createDataFrame([(q, v) for q, m in asked.items() for v in m], "query_id string, qv array<double>")
    tokens = spark.createDataFrame([(c, v) for c, m in chunks.items() for v in m] + [(99, None)], "chunk_id bigint, v array<double>")
    want = {(q, c): ((np.array(a) @ np.array(b).T).max(axis=1).mean() + 1) / 2 for q, a in asked.items() for c, b in chunks.items()}
    every = {(r["query_id"], r["chunk_id"]): r["sim"] for r in rerank.max_sim_all(queries, tokens, 2, 3).collect()}
    assert every == pytest.approx(want, abs=1e-5)
    top = lambda df: {(r["query_id"], r["chunk_id"], r["rank"]) for r in lexical.rank_hits(df.withColumnRenamed("sim", "score"), 6).collect()}
    assert top(rerank.max_sim_top(queries, tokens, 6, 2, 3)) == top(rerank.max_sim_all(queries, tokens))
    assert rerank.max_sim_top(queries.limit(0), tokens, 6).count() == rerank.max_sim_all(queries, tokens.limit(0)).count() == 0


def test_more_queries_than_travel_at_once(spark, monkeypatch):
    want = {tuple(r) for r in catalog.QUERIES["max_sim"](spark, SF).collect()}
    monkeypatch.setattr(rerank, "BROADCAST_NUMBERS", 64)
    assert {tuple(r) for r in catalog.QUERIES["max_sim"](spark, SF).collect()} == want and want


def test_no_task_sorts_all_pairs(spark):
    vectors = spark.range(2000).selectExpr("id", "transform(sequence(0, 7), i -> cast(sin(id * 7 + i) as double)) as v")
    found = rerank.max_sim_top(vectors.filter("id % 100 = 0").selectExpr("id as query_id", "v as qv"), vectors.selectExpr("id as chunk_id", "v"), 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert 20 * 3 <= found.count() < 20 * 2000 / 10
    assert "mapinarrow" in catalog.QUERIES["max_sim"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()

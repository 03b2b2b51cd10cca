import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann


def test_hilbert_is_a_continuous_bijection():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(vectors, query, k):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if query(q):
            others = sorted((-float(ann.cosines(good[q][None], good[i][None])[0]), i) for i in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in others]
    return out


def test_exact_where_windows_cover_all(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 4))
    rows = [(i, [float(x) for x in base[i % 60]]) for i in range(100)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(100)]  # copies: more than any window keeps
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 1.0, 0.0, 0.0]), (304, [float("inf"), 1.0, 0.0, 0.0]), (305, [1.0, 2.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 5 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows, lambda i: i % 5 == 0, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16))
    x = centers[rng.integers(0, 40, 4000)] + 0.15 * rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=300).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(4000) == q, -2, u[q] @ u.T))[:5].tolist())) for q in range(0, 4000, 50))
    assert hits / 400 >= 0.9


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    rows = ann.nearest(few, F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 0.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_very_small_and_large_components(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 4))
    factors = [1e-300, 1e300, 1.0, 1e-160, 1e160]
    rows = [(i, [float(x) for x in base[i] * factors[i % 5]]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q, found in got.items():
        sims = unit @ unit[q]
        order = [i for i in np.argsort(-sims) if i != q][:5]
        assert [i for i, _ in found] == order and [s for _, s in found] == pytest.approx([sims[i] for i in order])

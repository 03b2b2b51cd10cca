import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_small_table_is_searched_by_windows_too(spark, monkeypatch, kind):
    """Windows of one block on 8 curves visit as many rows as the table has; what they find is found, and nothing else."""
    monkeypatch.setattr(ann, "needed_reach", lambda *_: 0)
    n, rows, k = 2000, 256, 5
    x = np.random.default_rng(9).standard_normal((n, 16)).astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")
    x = x.astype(np.float64)
    keys = ann.curve_keys(ann.fit_curves(x), x)
    block = np.empty_like(keys)
    for c in range(keys.shape[1]):
        block[np.lexsort((np.arange(n), keys[:, c])), c] = np.arange(n) // rows
    want, exact = {}, 0
    for q in range(0, n, 50):
        seen = np.flatnonzero((block == block[q]).any(axis=1))
        scores = ann.cosines(np.broadcast_to(x[q], x.shape), x)
        want[q] = sorted((-scores[i], i) for i in seen.tolist() if i != q)[:k]
        exact += want[q] == sorted((-scores[i], i) for i in range(n) if i != q)[:k]
    assert exact < len(want)  # one block is too little here: the case tells windows from a comparison with all
    for dealt in (df.repartition(7), df.coalesce(1)):  # positions do not depend on how rows lie
        got = {}
        for r in ann.nearest(dealt, F.col("vec_id") % 50 == 0, block_rows=rows, reach=0, group=9).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert got == want

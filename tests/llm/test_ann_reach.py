import numpy as np
from pyspark.sql import functions as F

from tessella.llm import ann


def test_recall_holds_where_least_windows_are_a_small_part(spark):
    """Vectors without structure, windows of 3 blocks of 64 rows on 8 curves: far less than the table at the least reach."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=64, group=70).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(6000) == q, -2, u[q] @ u.T))[:5].tolist())) for q in range(0, 6000, 50))
    assert hits / 600 >= 0.9

import numpy as np
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_query_meets_every_vector(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    parts = {r["vec_id"]: np.array(r["embedding"], float).reshape(4, 16) for r in rows}
    unit = {i: v / np.linalg.norm(v, axis=1, keepdims=True) for i, v in parts.items()}
    want = {(q, d): ((unit[q] @ unit[d].T).max(axis=1).mean() + 1) / 2 for q in unit if q % 100 == 0 for d in unit}
    found = catalog.QUERIES["max_sim_all"](spark, SF).collect()
    got = {(r["query_id"], r["chunk_id"]): r["sim"] for r in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-4)

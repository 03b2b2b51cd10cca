import math

from pyspark.sql import functions as F

from tessella.operators import quality
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


def test_both_parts_equal_brute_force(spark):
    signals = quality.page_signals(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = signals.select("doc_id", "lang", "health_score", F.xxhash64(F.col("doc_id").cast("string"), F.lit(42)).alias("h")).collect()
    want = set()
    for lang in {r["lang"] for r in rows}:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["health_score"], r["doc_id"]))
        k = min(len(mine), max(30, math.ceil(len(mine) * 0.05)))
        want |= {(r["doc_id"], lang, "risk") for r in mine[: k // 2]}
        rest = sorted(mine[k // 2 :], key=lambda r: (r["h"], r["doc_id"]))
        want |= {(r["doc_id"], lang, "random") for r in rest[: k - k // 2]}
    found = [tuple(r) for r in catalog.QUERIES["qa_sample"](spark, SF).select("doc_id", "lang", "part").collect()]
    assert len(found) == len(want) and set(found) == want and {p for _, _, p in found} == {"risk", "random"}

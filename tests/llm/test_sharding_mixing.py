import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, sharding
from tessella.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    x = spark.range(n).select("id", sharding.feistel(F.col("id"), n, seed=7).alias("y"))
    back = x.withColumn("z", sharding.feistel(F.col("y"), n, seed=7, inverse=True)) if (lambda g: g[0] * g[1])(sharding.grid(n)) == n else x.withColumn("z", F.col("id"))
    rows = back.collect()
    assert sorted(r["y"] for r in rows) == list(range(n))
    assert all(r["z"] == r["id"] for r in rows)
    if n > 90:
        assert sum(r["y"] == r["id"] for r in rows) < 10


def test_inverse_walks_back(spark):
    n = 1001
    rows = spark.range(n).select("id", sharding.feistel(sharding.feistel(F.col("id"), n), n, inverse=True).alias("z")).collect()
    assert all(r["z"] == r["id"] for r in rows)


def check_shards(rows, docs):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(24))
    assert max(counts.values()) - (min(counts.values()) if len(counts) == 24 else 0) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_shards(hard, empty, documents, texts):
    check_shards(sharding.shard_documents(hard).collect(), [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()])
    rows = sharding.shard_documents(documents).collect()
    check_shards(rows, list(texts.items()))
    again = sharding.shard_documents(documents.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shard_documents(empty).count() == 0


def test_no_python_in_native_plans(documents):
    plan = sharding.shard_documents(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def scalar_targets(sizes, budget_share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = sum(sizes.values()) * budget_share, set()
    while True:
        left = budget - sum(repeats * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        share = {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        new = {s for s in rest if share[s] > repeats * sizes[s]}
        if not new:
            return {s: float(repeats * sizes[s]) if s in full else share[s] for s in order}
        full |= new


def check_mix(rows, docs):
    sizes = Counter()
    longest = Counter()
    for _, t, s in docs:
        n = len((t or "").encode().split())
        sizes[s] += n
        longest[s] = max(longest[s], n)
    want = scalar_targets({s: sizes[s] for _, _, s in docs})
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * max(longest.values()), s


def test_mix(hard, empty, documents):
    for docs in (hard, documents):
        want = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
        rows = mixing.mix_documents(docs).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in want)
        check_mix(rows, want)
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.mix_documents(documents).collect()) == key(mixing.mix_documents(documents.repartition(5)).collect())
    assert mixing.mix_documents(empty).count() == 0


def test_mix_with_few_words_in_a_heavy_source(spark):
    docs = spark.createDataFrame([(i, "w " * (3 if s == "a" else 50), s) for i, s in enumerate(["a"] * 4 + ["b"] * 40 + ["c"] * 200 + [None] * 5)], "doc_id bigint, text string, source string")
    rows = mixing.mix_documents(docs).collect()
    check_mix(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert all(r["taken"] == 2 * r["size"] for r in rows if r["source"] == "a")


def test_mix_equals_sql(documents):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op8_weighted_mix"]).fetchall())
    got = sorted(tuple(r) for r in mixing.mix_documents(documents).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_a_hot_source_is_split(documents):
    rows = mixing.count_rows(documents.withColumn("source", F.lit("one")))
    stored = rows.cache()
    per = defaultdict(int)
    for r in mixing.mix_rows(stored).collect():
        per[r["source"]] += r["takes"] * r["size"]
    total = sum(r["size"] for r in stored.collect())
    assert abs(per["one"] - 1.5 * total) <= 2 * max(r["size"] for r in stored.collect())

from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import simhash


def scalar_fingerprint(text, words=3):
    parts = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c", "é", " x"]), max_size=12), st.integers(1, 4))
def test_fingerprint(parts, words):
    text = " \t".join(parts)
    assert simhash.fingerprint(simhash.shingle_hashes(text, words)) == scalar_fingerprint(text, words)


def brute_components(fps):
    """Union-find over all pairs of distinct fingerprints within two bits."""
    parent = {f: f for f in fps.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for i, f in fps.items():
        least[root(f)] = min(least.get(root(f), i), i)
    return {i: least[root(f)] for i, f in fps.items()}


def test_documents_against_brute_force(documents, texts):
    rows = simhash.near_duplicates(documents).collect()
    fps = {i: scalar_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == fps
    assert {r["doc_id"]: r["component"] for r in rows} == brute_components(fps)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_on_planted_fingerprints(spark, radius):
    import random

    rng = random.Random(radius)
    fps = []
    for _ in range(30):
        base = rng.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(4)]
    chain = rng.getrandbits(64)
    for _ in range(25):  # a long chain that only components can follow
        fps.append(chain)
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), radius)
    labels = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    groups = {}
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(signed, 2):
        if ((a ^ b) % 2**64).bit_count() <= radius:
            parent[root(a)] = root(b)
    for f in signed:
        groups.setdefault(root(f), []).append(f)
    for g in groups.values():
        assert {labels.get(f, f) for f in g} == {min(g)}


def test_hard_rows(hard, empty):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component"]))
    assert by[1] == {(next(iter(by[1]))[0], 1)} and {c for _, c in by[2]} == {1}
    assert {c for i in (3, 4, 5) for _, c in by[i]} == {3} and {f for f, _ in by[3]} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_copies_beyond_one_ball(spark):
    """A third of all rows share one text; they are one fingerprint and no pair."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words in every copy").otherwise(F.concat(F.lit("own words number "), F.col("id").cast("string"))).alias("text"))
    rows = simhash.near_duplicates(docs).filter("doc_id % 3 = 0").select("component").distinct().collect()
    assert [r[0] for r in rows] == [0]

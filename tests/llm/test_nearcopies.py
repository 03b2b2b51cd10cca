from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessella.llm import nearcopies

DATA = "/root/testdata"


def brute_components(texts, least=0.8, words=5):
    """doc_id -> smallest doc_id reachable over pairs of that Jaccard similarity, all pairs compared."""
    sets = {i: set(nearcopies.shingle_set(t or "", words).tolist()) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(sets)
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            a, b = sets[i], sets[j]
            same = a == b
            if same or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) / len(a | b) >= least):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in order}


def test_stage_keeps_one_of_each_brute_force_group(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_components(texts)
    got = Counter(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, f"{DATA}/sf0.01").select("doc_id").collect())
    assert got == Counter(set(want.values()))
    assert want[255] == want[1] and want[56] == want[2]  # near copies that no 2-bit ball of fingerprints joins


def test_similarity_decides_exactly(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    base, cut, more = " ".join(words), " ".join(words[:84]), " ".join(words[:83])  # 80 and 79 of them
    docs = spark.createDataFrame([(1, base), (2, cut), (3, "other words " * 9), (4, None), (5, " ")], "doc_id bigint, text string")
    kept = lambda d: sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, d, "").collect())
    assert kept(docs) == [1, 3, 4]
    assert kept(spark.createDataFrame([(1, base), (2, more)], "doc_id bigint, text string")) == [1, 2]


def test_a_crowd_in_one_band_is_split_exactly(spark):
    """Members of a band that are linked to its first, to each other only, or to none."""
    rng = __import__("random").Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(240):  # a chain of small edits: neighbours are similar, the ends are not
        at = rng.randrange(200)
        base = [*base[:at], f"x{i}", *base[at + 1 :]]
        texts[i] = " ".join(base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = nearcopies.durable(nearcopies.band_rows(docs))
    got = {r["doc_id"]: r["component"] for r in nearcopies.assign_near_copies(rows, docs).collect()}
    assert got == brute_components(texts)


def test_members_left_apart_by_the_first_are_compared(spark):
    """Nodes 2 and 3 share bands with 1, are not similar to it, but to each other."""
    sets = spark.createDataFrame([(1, [*range(10)]), (2, [*range(5, 15)]), (3, [*range(5, 16)])], "node bigint, shingles array<bigint>")
    nodes = spark.createDataFrame([(1, 10, [7, 8, 9]), (2, 10, [7, 8, 9]), (3, 11, [7, 8, 9])], "node bigint, n int, bands array<bigint>")
    shared = nearcopies.shared_bands(nodes)
    assert shared.count() == 9
    none = spark.createDataFrame([], "node bigint, label bigint")
    pairs = nearcopies.cross_pairs(shared, none, 0.8)
    assert sorted(map(tuple, pairs.collect())) == [(2, 1), (3, 1), (3, 2)]
    assert [tuple(r) for r in nearcopies.similar(pairs, sets, 0.8).collect()] == [(3, 2)]
    joined = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node bigint, label bigint")
    assert nearcopies.cross_pairs(shared, joined, 0.8).count() == 0


def test_balls_of_fingerprints_link_without_any_band(spark):
    """A pair within 2 bits is joined by SimHash alone; what the balls join wrongly is not."""
    fp = lambda t: nearcopies.fingerprint(nearcopies.shingle_set(t, 5))
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    near = next(t for t in (" ".join([*words, f"x{i}"]) for i in range(500)) if 1 <= (fp(t) ^ fp(base)).bit_count() <= 2)
    docs = spark.createDataFrame([(1, base), (2, near), (3, "some other words of a text"), (4, None), (5, "")], "doc_id bigint, text string")
    rows = nearcopies.band_rows(docs).withColumn("bands", F.array().cast("array<bigint>"))
    got = {r["doc_id"]: r["component"] for r in nearcopies.assign_near_copies(nearcopies.durable(rows), docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    false = rows.withColumn("fp", F.lit(7).cast("bigint"))
    got = {r["doc_id"]: r["component"] for r in nearcopies.assign_near_copies(nearcopies.durable(false), docs).collect()}
    assert got[3] == 3 and got[4] == got[5] == 4 and got[1] == 1


def test_ball_pairs_are_those_within_two_bits(spark):
    nodes = spark.createDataFrame([(10, 0), (5, 3), (7, 3), (20, 7), (30, -1), (40, -1 << 63 ^ -1)], "node bigint, fp bigint")
    assert sorted(map(tuple, nearcopies.ball_pairs(nodes).collect())) == [(7, 5), (10, 5), (20, 5), (40, 30)]

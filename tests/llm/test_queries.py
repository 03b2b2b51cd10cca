"""The registered queries against brute force or an independent reading of their contracts, on whole small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessella.llm import ann, langid, toxicity
from tessella.llm.common import letter_words
from tessella.llm.queries import QUERIES
from tests.llm.test_sharding_mixing import check_shards

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    label = {i: i for i in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(prints)
    for at, i in enumerate(order):
        for j in order[:at]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    rows = QUERIES["op4_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", root(i)) for i in prints}
    assert len(rows) == len(prints)


def test_sharding_query(spark, texts):
    rows = QUERIES["op5_feistel_shards"](spark, SF).collect()
    check_shards(rows, list(texts.items()))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_neighbours_query(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None}
    got = {}
    for r in QUERIES["op9_hilbert_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == {i for i in vectors if i % 50 == 0}
    for q, found in got.items():
        want = sorted((-float(ann.cosines(vectors[q][None], v[None])[0]), i) for i, v in vectors.items() if i != q)[:5]
        assert found == [(i, -s) for s, i in want]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_query_and_its_ratios(spark, tables, texts):
    """Counts, ratios and the choice of grams by plain loops over the labelled texts that may be learnt from."""
    labels = {r["doc_id"]: r["toxic"] > 0 for r in tables[1].collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["toxic"] is not None}
    sets = [(labels[i], {g for w in letter_words(t or "") for g in toxicity.grams(w)}) for i, t in texts.items() if i in labels]
    n1, n0 = sum(y for y, _ in sets), sum(not y for y, _ in sets)
    p, q = Counter(), Counter()
    for y, found in sets:
        (p if y else q).update(found)
    want = {}
    for g in p.keys() | q.keys():
        cells = [(p[g], p[g] + q[g], n1), (q[g], p[g] + q[g], n0), (n1 - p[g], n1 + n0 - p[g] - q[g], n1), (n0 - q[g], n1 + n0 - p[g] - q[g], n0)]
        deviance = 2 * sum(x * math.log(x * (n1 + n0) / (row * column)) for x, row, column in cells if x)
        if math.sqrt(max(0.0, deviance)) >= 2:
            want[g] = math.log((p[g] + 0.5) / (n1 + 1)) - math.log((q[g] + 0.5) / (n0 + 1))
    sample = spark.createDataFrame([(labels[i], sorted(set(letter_words(t or "")))) for i, t in texts.items() if i in labels], "y boolean, w array<string>")
    got = dict(toxicity.gram_ratios(sample, (n0, n1), 2.0))
    assert got == pytest.approx(want) and want

    model = toxicity.train_toxicity(*tables)
    rows = QUERIES["op2_toxicity"](spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    for r in rows:
        assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]] or "")) and r["predicted"] == int(r["score"] >= 0.5)


def test_language_query_against_dense_vectors(spark, tables, texts):
    """Every document by whole dense TF-IDF vectors whose counts and frequencies are taken from the texts again."""
    langs = {r["doc_id"]: r["lang"] for r in tables[0].collect()}
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1 and langs[i] is not None]
    tf = {i: Counter(g for w in letter_words(t or "") for g in langid.grams(w)) for i, t in texts.items()}
    df = Counter(g for i in {(langs[i], i, texts[i]): i for i in learnt}.values() for g in tf[i])
    model = langid.train_languages(tables[0])
    assert set(model.vocabulary) == {g for g, n in df.items() if n >= 2}
    idf = {g: math.log((1 + len(learnt)) / (1 + df[g])) + 1 for g in model.vocabulary}
    rows = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(map(langid.has_letter, letter_words(t or ""))):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0)
            continue
        v = np.zeros(len(model.vocabulary))
        for g, n in tf[i].items():
            if g in idf:
                v[model.vocabulary[g]] = math.log1p(n) * idf[g]
        sims = model.centroids @ (v / np.linalg.norm(v))
        assert rows[i]["score"] == pytest.approx(float(sims.max()), abs=1e-5)
        assert rows[i]["lang_pred"] == model.languages[model.owner[int(sims.argmax())]]


def test_language_centroids_are_means_of_their_texts(tables, texts):
    """Each centroid is the normalised sum of the training vectors nearest to it, as spherical k-means leaves them."""
    model = langid.train_languages(tables[0])
    langs = {r["doc_id"]: r["lang"] for r in tables[0].collect()}
    for i, lang in enumerate(model.languages):
        mine = model.centroids[model.owner == i].astype(float)
        x = []
        for k, t in texts.items():
            if langs[k] == lang and zlib.crc32(str(k).encode()) % 3 != 1:
                at, values = model.sparse(Counter(letter_words(t or "")))
                if len(at):
                    v = np.zeros(len(model.vocabulary))
                    v[at] = values
                    x.append(v)
        near = (np.array(x) @ mine.T).argmax(axis=1)
        sums = np.stack([np.array(x)[near == j].sum(axis=0) for j in range(len(mine))])
        means = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        assert np.mean([(means[j] * mine[j]).sum() > 0.99 for j in range(len(mine)) if (near == j).any()]) > 0.7


def test_columns_of_all_queries(spark):
    want = {
        "op1_mpeg_audio": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
        "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op5_feistel_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op6_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op7_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op8_weighted_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op9_hilbert_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
        "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    }
    for name, columns in want.items():
        have = [f"{n} {t}" for n, t in QUERIES[name](spark, SF).dtypes]
        assert have[: len(columns.split(", "))] == columns.split(", "), name

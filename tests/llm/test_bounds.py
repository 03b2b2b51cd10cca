"""Bounds of samples and of tasks where one key, text or source holds a third of all rows or more."""

import random
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, mixing, packing, secrets, sharding, toxicity
from tessella.llm.common import PIECE_ROWS, bounded_sample, equal_groups, expand_groups, group_sizes, number_groups
from tests.llm.test_sharding_mixing import check_mix, check_shards


@pytest.fixture(scope="module")
def one_id(spark, tmp_path_factory):
    """9,000 rows of which a third share one id, some of them also their text."""
    path = str(tmp_path_factory.mktemp("one") / "documents.parquet")
    text = F.when(F.col("n") < 1000, F.lit("the same words again")).otherwise(F.concat(F.lit("word und mot number "), F.col("n").cast("string"), F.when(F.col("n") % 2 == 0, F.lit(" idiot")).otherwise(F.lit(" kind"))))
    rows = spark.range(9000).select(F.col("id").alias("n")).select(F.when(F.col("n") < 3000, F.lit(7)).otherwise(F.col("n")).alias("doc_id"), text.alias("text"), F.when(F.col("n") % 2 == 0, "en").otherwise("de").alias("lang"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_sample_is_bounded_by_rows(one_id):
    rows = one_id.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), "lang")
    got = bounded_sample(rows, 50, ["lang"]).collect()
    assert Counter(r["lang"] for r in got) == {"en": 50, "de": 50}
    assert len(bounded_sample(rows, 50, ["lang"], most=60).collect()) == 60
    assert len(bounded_sample(rows, 40).collect()) == 40
    assert len({(r["k"], r["lang"], r["t"]) for r in got}) == len(got)


def test_a_repeated_row_is_sampled_once(spark):
    rows = spark.createDataFrame([(1, "a", "en")] * 500 + [(2, "b", "en"), (2, "c", "en")], "k bigint, t string, lang string")
    assert Counter((r["k"], r["t"]) for r in bounded_sample(rows, 100, ["lang"]).collect()) == {(1, "a"): 1, (2, "b"): 1, (2, "c"): 1}


def test_classifiers_fit_no_more_than_their_bound(spark, one_id, monkeypatch):
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda rows, vocabulary: seen.append(len(rows)) or fit(rows, vocabulary))
    langid.train_languages(one_id, per_language=50, fold_out=None)
    assert seen == [100]
    many = one_id.withColumn("lang", F.col("doc_id").cast("string"))  # thousands of languages
    langid.train_languages(many, per_language=50, fold_out=None, most_rows=70)
    assert seen[1] == 70
    learnt = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *more: seen.append(len(rows)) or learnt(rows, *more))
    labels = one_id.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.train_toxicity(one_id, labels, per_class=50, hold_out=None)
    assert seen[2] == 100


def test_markov_samples_cover_whole_texts_within_their_bound(spark, one_id):
    ordinary = secrets.labelled_samples(one_id, sample_rows=50, generated=10).filter("label = 'ordinary'")
    assert 0 < ordinary.count() <= 50
    words = ["".join(random.Random(i).choices(string.ascii_lowercase, k=8)) for i in range(9000)]
    long = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    got = [r["text"] for r in secrets.labelled_samples(long, generated=10).filter("label = 'ordinary'").collect()]
    assert len(got) <= 100
    at = sorted(words.index(t[:8]) for t in got)
    assert at[0] < 100 and at[-1] > 8800 and max(b - a for a, b in zip(at, at[1:])) < 200


def test_one_language_text_is_one_vote_whatever_its_order(spark, one_id):
    a, b = (langid.train_languages(d, per_language=30, fold_out=None) for d in (one_id, one_id.repartition(5)))
    assert a.vocabulary == b.vocabulary and (a.centroids == b.centroids).all()


@pytest.fixture(scope="module")
def third_equal(spark):
    rows = [(1, "same text", "a")] * 3000 + [(i, f"text {i % 50} " * (i % 7 + 1), "b") for i in range(2, 6002)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def test_equal_rows_are_one_until_dealt(spark, third_equal):
    groups = equal_groups(third_equal.select("doc_id", "text"))
    assert group_sizes(groups) == (9000, 3000) and groups.count() == 6001
    numbered = number_groups(groups, [], 9000)
    rows = expand_groups(numbered, 3000).select((F.col("__first") + F.col("__nth")).alias("n")).collect()
    assert sorted(r["n"] for r in rows) == list(range(9000))


def test_pieces_of_a_hot_group_are_spread(spark):
    n = 3 * PIECE_ROWS + 5
    groups = spark.createDataFrame([("hot", n), ("cold", 2)], "k string, __count bigint")
    parts = expand_groups(groups, n).select("k", "__nth", F.spark_partition_id().alias("p"))
    assert parts.groupBy("k").agg(F.count_distinct("__nth").alias("n"), F.max("__nth").alias("m")).sort("k").collect() == [("cold", 2, 1), ("hot", n, n - 1)]
    assert parts.filter("k = 'hot'").groupBy("p").count().agg(F.max("count")).collect()[0][0] < n


def test_numbers_follow_each_group_with_nulls(spark):
    rows = spark.createDataFrame([(None, i % 3) for i in range(10)] + [(1, None)] * 4 + [(1, 2)], "g int, v int")
    numbered = expand_groups(number_groups(equal_groups(rows), ["g"], 15), 5).select("g", (F.col("__first") + F.col("__nth")).alias("n")).collect()
    for g, size in ((None, 10), (1, 5)):
        assert sorted(r["n"] for r in numbered if r["g"] == g) == list(range(size))


def test_shards_and_packing_with_a_third_equal(third_equal):
    docs = [(r["doc_id"], r["text"]) for r in third_equal.collect()]
    check_shards(sharding.shard_documents(third_equal).collect(), docs)
    pieces = third_equal.select("doc_id", F.lit(0).cast("bigint").alias("start"), (F.length("text") * 30).cast("bigint").alias("length"), F.crc32(F.col("text").cast("binary")).alias("ids_crc32"), F.lit(9).cast("bigint").alias("doc_tokens"))
    places = packing.pack_pieces(pieces).collect()
    assert len(places) == 9000
    taken = Counter()
    for r in places:
        taken[r["sequence_id"]] += r["length"]
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in places)
    assert max(taken.values()) <= 2048 and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_mix_of_equal_rows_wordless_sources_and_late_finishes(spark, third_equal):
    wordless = spark.createDataFrame([(i, "", "none") for i in range(10_000, 14_000)], "doc_id bigint, text string, source string")
    late = spark.createDataFrame([(20_000 + i, "word " * 400, f"late{i}") for i in range(6)], "doc_id bigint, text string, source string")
    for docs in (third_equal, third_equal.unionByName(wordless), late, wordless):
        rows = mixing.mix_documents(docs).collect()
        check_mix(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_the_mix_is_cut_where_plain_queueing_cuts_it(spark, third_equal):
    """The whole queue merged in one sorted list, as the definition says."""
    docs = third_equal.unionByName(spark.createDataFrame([(30_000, "long " * 30_000, "c"), (30_001, None, None)], "doc_id bigint, text string, source string"))
    rows = mixing.count_rows(docs)
    targets = {r["source"]: r for r in mixing.source_targets(rows, 1.5, 2, mixing.WEIGHTS).collect()}
    import hashlib

    queue, cum = [], Counter()
    for r in rows.collect():
        for epoch in range(2):
            name = hashlib.md5(f"0:{epoch}:{'' if r['doc_id'] is None else r['doc_id']}:{r['size']}:{r['occurrence']}".encode()).hexdigest()
            queue.append((r["source"], epoch, name, r["doc_id"], r["size"], r["occurrence"]))
    timed = []
    for s, epoch, name, i, size, nth in sorted(queue, key=lambda q: (str(q[0]), q[1], q[2])):
        cum[s] += size
        t = targets[s]
        timed.append((cum[s] / t["target"] if t["target"] else 0.0, t["rank"], epoch, name, i, size, nth, s))
    total, want = 0, Counter()
    for finish, rank, epoch, name, i, size, nth, s in sorted(timed, key=lambda t: t[:4]):
        total += size
        want[s, i, size, nth] += total <= targets[s]["budget"]
    got = {(r["source"], r["doc_id"], r["size"], r["occurrence"]): r["takes"] for r in mixing.mix_rows(rows).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("kind", ["run", "many"])
def test_scans_of_long_texts_are_linear(spark, documents, kind, tmp_path):
    rng = random.Random(1)
    letters = string.ascii_letters + string.digits + "+/"
    n = 1_000_000
    pieces = ["".join(rng.choices(letters, k=n))] if kind == "run" else ["".join(rng.choices("0123456789abcdef" if i % 2 else letters, k=24)) for i in range(n // 25)]
    path = str(tmp_path / "text")
    spark.createDataFrame([(1, " ".join(pieces))], "doc_id bigint, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    model = secrets.train_markov(secrets.labelled_samples(documents))
    began = time.perf_counter()
    (row,) = secrets.scan_secrets(docs, model).select("spans", secrets.redact(F.col("text"), F.col("spans")).alias("masked"), "text").collect()
    assert time.perf_counter() - began < 60
    want, at = [], 0
    for s in row["spans"]:
        want += [row["text"][at : s["start"]], "[SECRET]"] if s["start"] >= at else []
        at = max(at, s["end"])
    assert row["masked"] == "".join(want) + row["text"][at:]
    assert len(row["spans"]) == 1 if kind == "run" else len(row["spans"]) >= len(pieces) * 0.4


def test_before_each(spark):
    rows = spark.createDataFrame([([*range(n)],) for n in (0, 1, 2, 31, 32, 33, 100, 1025)], "v array<int>")
    got = rows.select("v", secrets.before_each(F.col("v"), lambda a, b: a + b).alias("s"), secrets.before_each(F.reverse("v"), secrets._larger, -5).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]
        assert r["m"] == [max([*r["v"][::-1][:i], -5]) for i in range(len(r["v"]))]

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessella.llm import mixing, secrets, toxicity
from tessella.llm.queries import QUERIES
from tessella.session import scratch, shared_dir
from tests.llm.test_nearcopies import brute_components

SF = "/root/testdata/sf0.001"
PLAIN = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage leaves, written and read as the pipeline's runner does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    before, after = stages[0], stages[1]
    model = toxicity.train_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if model.score(r["text"] or "") < 0.5}


def test_one_of_each_group_stays(stages):
    """Groups of near copies as the stage defines them (five-word shingles, Jaccard 0.8 or more), by brute force."""
    groups = brute_components({r["doc_id"]: r["text"] for r in stages[1].collect()})
    assert Counter(r["doc_id"] for r in stages[2].collect()) == Counter(set(groups.values()))


def test_secrets_are_masked(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i]["text"] != after[i]["text"]}
    spans = stages[2].select("doc_id", secrets.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert {r["doc_id"] for r in spans if r["s"]} <= changed
    assert all("[SECRET]" in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"]) for i in changed)


def test_rows_appear_as_often_as_taken(stages):
    takes = mixing.mix_documents(stages[3]).collect()
    want = Counter()
    for r in takes:
        want[r["doc_id"]] += r["takes"]
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +want


def test_all_is_packed(stages):
    assert stages[5].filter("start = 0").count() == stages[4].count()


def test_run_equals_the_stages(spark, stages):
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == Counter(map(tuple, stages[5].collect()))


def test_stages_take_hard_rows(spark, hard, empty, tmp_path):
    docs = hard
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() > 0
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_repeated_rows_are_dealt_their_takes(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 3 + [(i, "word " * 9, "en", "t", 45) for i in range(10, 30)], PLAIN)
    got = Counter(r["doc_id"] for r in cp.mix_sources(spark, docs, SF).collect())
    want = Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r["doc_id"]] += r["takes"]
    assert got == +want
    assert cp.drop_near_duplicates(spark, docs, SF).filter("doc_id = 1").count() == 1


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]


def test_many_equal_rows_share_the_takes_of_their_like(spark):
    """A third of all rows is one row; others share id, source and size with different texts."""
    rows = [(1, "a b c", "en", "s", 5)] * 200 + [(2, t, "en", "s", 5) for t in ("a b c", "b c a", "c a b")] * 3 + [(i, "word " * 9, "en", "t", 45) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, PLAIN)
    got = Counter((r["doc_id"], r["text"]) for r in cp.mix_sources(spark, docs, SF).collect())
    want, each = Counter(), Counter((r[0], r[1]) for r in rows)
    for r in mixing.mix_documents(docs).collect():
        want[r["doc_id"]] += r["takes"]
    by = Counter()
    for (i, _), n in got.items():
        by[i] += n
    assert by == +want and all(n <= 2 * each[k] for k, n in got.items())


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    from pathlib import Path

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    for name in ("op3_packing", "op4_simhash", "op8_weighted_mix", "pipeline"):
        with scratch():
            QUERIES[name](spark, SF).write.parquet(str(tmp_path / name))
        assert {p.name for p in shared.iterdir()} == before, name

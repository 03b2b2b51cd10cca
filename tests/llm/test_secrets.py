import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import secrets
from tessella.llm.queries import op7_secrets

KEYS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def scalar_base(text):
    out = [(m.start(), 0, m.end()) for m in KEYS.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "hunter22", "é", "🙂", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0f", "token=abc", "secret=token:abcdefgh", "K", "ſ"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=20, max_size=40))
def test_base_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", secrets.base_spans(F.col("text")).alias("s")).collect():
        assert [(x["start"], x["kind"], x["end"]) for x in r["s"]] == scalar_base(texts[r["i"]]), texts[r["i"]]


@pytest.fixture(scope="module")
def model(documents):
    return secrets.train_markov(secrets.labelled_samples(documents))


def scalar_score(model, text):
    size = len(secrets.ALPHABET)
    at = [secrets.ALPHABET.index(c) for c in text]
    return sum(model.ratios[a * size + b] for a, b in zip(at, at[1:])) / (len(text) - 1)


def scalar_spans(model, text):
    base = scalar_base(text)
    more = [(m.start(), 3, m.end()) for m in re.finditer(secrets.CANDIDATE, text) if not any(a < m.end() and m.start() < b for a, _, b in base) and scalar_score(model, m[0]) > model.threshold]
    return sorted(base + more)


def test_model_tells_random_from_ordinary(spark, model):
    good = ["customer_account_identifier", "the-quick-brown-fox-jumps", "internationalization_of_words"]
    bad = [hashlib.sha256(b"a").hexdigest()[:40].upper(), "xK9vQ2mZ7rT4wB1nL8pD3jF6", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", model.score(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r["s"] == pytest.approx(scalar_score(model, r["t"]))
        assert (r["s"] > model.threshold) == (r["t"] in bad), r


def test_whole_scan(spark, hard, empty, model):
    extra = [(100 + i, f"key xK9vQ2mZ7rT4wB1nL8pD3jF6{i} end 🙂 é passwd='abcdef{i}' tail") for i in range(3)]
    docs = hard.select("doc_id", "text", "spans").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string").withColumn("spans", F.lit("taken")))
    for r in secrets.scan_secrets(docs, model, base="b", spans="all").collect():
        assert [(x["start"], x["kind"], x["end"]) for x in r["all"]] == scalar_spans(model, r["text"] or "")
    assert secrets.scan_secrets(empty, model, base="b", spans="all").count() == 0


def test_no_samples_still_gives_a_model(empty):
    assert secrets.train_markov(secrets.labelled_samples(empty, generated=50)).threshold > 0


def test_redaction(spark):
    text = "é token = 'abcdef0123456789abcdef01' 🙂 end deadbeefdeadbeefdeadbeef"
    df = spark.createDataFrame([(text,), ("plain",), (None,)], "text string")
    rows = [r[0] for r in df.select(secrets.redact(F.col("text"), secrets.base_spans(F.coalesce("text", F.lit("")))).alias("t")).collect()]
    assert rows == ["é [SECRET]' 🙂 end [SECRET]", "plain", None]


def test_query(spark, texts):
    rows = {r["doc_id"]: r for r in op7_secrets(spark, "/root/testdata/sf0.001").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        base = scalar_base(t)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == n for x in base) for n in range(3)]
        assert {*said.split(",")} - {""} <= {*rows[i]["spans"].split(",")}


def test_native_plan(documents, model):
    plan = secrets.scan_secrets(documents, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

import hashlib
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.functions import vectors as vx

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
MIXED = st.lists(st.sampled_from(["记忆系统", "什么", "的", "目标", "Abc", "x_1", " ", "，", "\n", "是", "一", "CPO体验", "é", "-"]), max_size=10).map("".join)


def column(spark, texts, c):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", c.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def scalar_terms(text):
    out = []
    for run in re.findall(r"[一-鿿]+|[0-9A-Za-z_]+", text):
        if re.match(r"[A-Za-z0-9_]", run):
            out.append(run.lower())
        elif len(run) == 1:
            out.append(run)
        else:
            for n in (2, 3):
                out += [run[k : k + n] for k in range(len(run) - n + 1)]
            if len(run) <= 6:
                out.append(run)
    return [t for t in out if t not in fx.STOP_TERMS]


@quick
@given(st.lists(MIXED, min_size=5, max_size=30))
def test_terms(spark, texts):
    assert column(spark, texts, fx.terms("text")) == [scalar_terms(t) for t in texts]


def test_phrases(spark):
    assert column(spark, ["CPO 体验治理的目标是什么 a b2"], fx.phrases("text")) == [
        ["cpo", "体验治理的目标是什么"[:3]] + ["验治理", "治理的", "理的目", "的目标", "目标是", "标是什", "是什么", "体验治理", "验治理的", "治理的目", "理的目标", "的目标是", "目标是什", "标是什么", "b2"]
    ]
    assert column(spark, ["如何 报销"], fx.phrases("text")) == [["报销"]]


def test_token_estimate(spark):
    texts = ["", "hello world", "记忆 memory", "a_b c"]
    assert column(spark, texts, fx.token_estimate("text")) == [int(1.5 * len(re.findall("[一-鿿]", t)) + 1.3 * len(re.findall(r"[A-Za-z0-9_]+", t))) + 1 for t in texts]


@quick
@given(st.lists(st.text(st.sampled_from(list("ab\n\r\x0b\x0c\x1c\x85  ")), max_size=12), min_size=5, max_size=20))
def test_lines_and_trims(spark, texts):
    assert column(spark, texts, fx.split_lines("text")) == [t.splitlines() for t in texts]
    assert column(spark, texts, fx.trim_blank("text")) == [t.strip() for t in texts]


def test_char_windows(spark):
    assert column(spark, ["abcdef", "", "  ab  "], fx.char_windows("text", 3, 1)) == [["abc", "cde", "ef"], [], ["ab"]]
    assert column(spark, ["abc"], fx.char_windows("text", 2, 5)) == [["ab", "bc", "c"]]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, -0.0], [0.4, 0.9], 0.4 / math.hypot(0.4, 0.9)), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 2.0, 2.0], [1.0], 1 / 3)]
    got = spark.createDataFrame([r[:2] for r in rows], "a array<double>, b array<double>").select(vx.cosine("a", "b").alias("v")).collect()
    assert [r["v"] for r in got] == pytest.approx([r[2] for r in rows])


def scalar_hashed(text, dim=128):
    v = [0.0] * dim
    for run in re.findall(r"[一-鿿]+|[0-9A-Za-z_]+", text.lower()):
        for t in [run] if run.isascii() else [*run, *(run[k : k + 2] for k in range(len(run) - 1))]:
            d = hashlib.sha256(t.encode()).digest()
            v[int.from_bytes(d[:4], "big") % dim] += -1.0 if d[4] % 2 else 1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def test_hashed_embedding(spark):
    texts = ["", "the cat and the cat", "记忆系统 memory", "x"]
    for got, t in zip(column(spark, texts, vx.hashed_embedding("text")), texts, strict=True):
        assert got == pytest.approx(scalar_hashed(t))


def test_digest_embedding(spark):
    (v,) = column(spark, ["token"], vx.digest_embedding("text", 64))
    raw = b"".join(hashlib.blake2b(f"token:{i}".encode(), digest_size=32).digest() for i in range(2))
    want = [b / 127.5 - 1 for b in raw]
    n = math.sqrt(sum(x * x for x in want))
    assert v == pytest.approx([x / n for x in want])


def test_squeeze_and_compact(spark):
    assert column(spark, ["A b_C，d!"], fx.compact("text")) == ["abcd"]
    assert column(spark, [" A　b "], fx.squeeze("text")) == ["ab"]
    assert column(spark, ["abc"], fx.ngrams("text", 4)) == [[]]
    assert spark.range(1).select(fx.let(F.lit(2), lambda x: x + x).alias("v")).collect()[0]["v"] == 4

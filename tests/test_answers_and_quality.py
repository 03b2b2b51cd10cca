import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluation, layout, prompt, quality
from tessella.operators.evaluation import Gates

HIT = "query_id string, rank int, score double, chunk_id string, content string, source string, page int, heading_path string, version int"


def messages(spark, hits, queries=(("q", "退款期限？"),), history=None):
    asked = spark.createDataFrame(list(queries), "query_id string, query string")
    if history:
        asked = asked.withColumn("history", F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in history]))
    return prompt.assemble_prompts(asked, spark.createDataFrame(hits, HIT))


def test_prompt_blocks(spark):
    hits = [("q", 1, 0.87654, "d::0", " 七天内退款 ", "rückgabe.md", 3, "政策 > 退款", 2), ("q", 2, 0.5, "", "  ", "", None, "", None)]
    got = messages(spark, hits, history=[("user", "hi"), ("assistant", "yes")]).collect()[0]["messages"]
    assert [m["role"] for m in got] == "system user assistant user".split()
    assert got[-1]["content"] == "【上下文】\n[片段1 | 来源:rückgabe.md | 相关度:0.877 | chunk_id:d::0 | 页码:3 | 章节:政策 > 退款 | 版本:2]\n七天内退款\n\n[片段2 | 来源:NA | 相关度:0.500]\n（空片段）\n\n【问题】\n退款期限？"


def test_no_context_and_page_zero(spark):
    assert messages(spark, []).collect()[0]["messages"][-1]["content"] == "【上下文】\n（无检索结果）\n\n【问题】\n退款期限？"
    text = messages(spark, [("q", 1, 1.0, "c", "x", "s", 0, "", 1)]).collect()[0]["messages"][-1]["content"]
    assert "页码:0" in text


def test_offline_answers(spark):
    df = messages(spark, [("q", 1, 1.0, "c", "first evidence\nline two", "s", 0, "", 1), ("q", 2, 0.9, "e", "second", "t", 0, "", 1)])
    row = df.select(prompt.extractive_answer(F.col("messages")).alias("x"), prompt.echo_answer(F.col("messages")).alias("e")).collect()[0]
    assert row["x"] == "first evidence\nline two" and row["e"] == "[mock-llm] 已收到 2 条消息，问题：退款期限？"
    assert messages(spark, []).select(prompt.extractive_answer(F.col("messages"))).collect()[0][0] == prompt.UNKNOWN


def test_memory(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(14)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["turn"]: [m["content"] for m in r["history"]] for r in prompt.memory_window(df).collect()}
    assert got[0] == [] and got[3] == ["m0", "m1", "m2"] and got[13] == [f"m{t}" for t in range(3, 13)]
    assert prompt.last_turns(df, 3).count() == 3 and prompt.last_turns(df, 0).count() == 14


RANKED = "query_id string, rank int, score double, source string, doc_id string, chunk_id string"
LABELS = "query_id string, relevant_sources array<string>, relevant_doc_ids array<string>, relevant_chunk_ids array<string>"


def test_retrieval_report(spark):
    hits = spark.createDataFrame([("a", 1, 0.4, "x", "x", "1"), ("a", 2, 0.3, "y", "y", "2"), ("a", 3, 0.2, "x", "x", "3"), ("b", 1, 0.4, "x", "x", "1"), ("b", 2, 0.2, "x", "x", "2")], RANKED)
    labels = spark.createDataFrame([("a", ["y"], [], []), ("b", [], [], []), ("c", [], ["d"], [])], LABELS)
    queries = labels.withColumn("labelled", F.size("relevant_sources") + F.size("relevant_doc_ids") > 0)
    reports = evaluation.retrieval_report(evaluation.mark_relevant(hits, labels), queries, (3, 1, 2, 2, -1))
    got = {r["query_id"]: r for r in reports.collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["best_rank"], a["mrr"], a["hit_at_k"], a["precision_at_k"], a["recall_at_k"]) == (2, 0.5, {1: False, 2: True, 3: True}, {1: 0.0, 2: 0.5, 3: 0.333333}, {1: 0.0, 2: 1.0, 3: 1.0})
    assert (b["labelled"], b["best_rank"], b["hit_at_k"], b["mean_score"], b["max_score"], b["source_diversity"]) == (False, None, None, 0.3, 0.4, 0.5)
    assert (c["candidate_count"], c["mrr"], c["hit_at_k"]) == (0, 0.0, {1: False, 2: False, 3: False})
    s = evaluation.summarise_reports(reports, (1, 2, 3)).collect()[0]
    assert (s["query_count"], s["labelled_query_count"], s["average_mrr"], s["hit_rate_at_k"][2]) == (3, 2, 0.25, 0.5)


def test_suite_metrics_and_gates(spark):
    schema = "passed boolean, hit_at_1 boolean, hit_at_3 boolean, reciprocal_rank double, answer_term_hits int, answer_term_total int, grounded_answer boolean, forbidden_term_hits int, case_latency_ms double"
    rows = [(True, True, True, 1.0, 2, 2, True, 0, float(i)) for i in range(1, 20)] + [(False, False, True, 0.5, 1, 4, False, 1, 500.0)]
    m = evaluation.suite_metrics(spark.createDataFrame(rows, schema)).collect()[0].asDict()
    assert m == {"case_pass_rate": 0.95, "hit_rate_at_1": 0.95, "hit_rate_at_3": 1.0, "mrr": 0.975, "answer_term_recall": round(39 / 42, 6), "grounded_answer_rate": 0.95, "forbidden_term_violation_rate": 0.05, "p95_case_latency_ms": 19.0}
    assert Gates().failed(m) == ["max_forbidden_term_violation_rate", "min_grounded_answer_rate", "min_case_pass_rate", "min_answer_term_recall"]
    none = evaluation.suite_metrics(spark.createDataFrame([], schema)).collect()[0].asDict()
    assert none["case_pass_rate"] == none["mrr"] == 1.0 and none["p95_case_latency_ms"] == 0.0
    assert Gates.load('{"min_mrr": 0.5}').min_mrr == 0.5
    for bad in ({"min_unknown": 1}, {"min_mrr": 1.5}, {"max_p95_case_latency_ms": -1}, "[]"):
        with pytest.raises(ValueError):
            Gates.load(bad)


def test_grounding(spark):
    df = spark.createDataFrame([("3 天", "应在 3天 内提交"), ("", "x"), ("no", "yes")], "a string, e string")
    assert [r[0] for r in df.select(evaluation.is_grounded(F.col("a"), F.col("e"))).collect()] == [True, False, False]


def test_page_health_and_review(spark):
    rows = [(f"doc{i}.md", i, "clear readable text of a page", 1.0) for i in range(5)] + [("doc9.md", 9, "��� ��� ���", 0.3), ("doc8.md", 8, "short", 1.0), ("doc7.md", 7, "a hyphen-\nated word in here", 0.9)]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, ocr_confidence double")
    got = {r["page"]: r for r in quality.page_signals(df).collect()}
    assert got[0]["health_score"] == 1.0 and got[8]["is_blank"] and got[8]["health_score"] == 0.0
    assert got[7]["hyphen_breaks"] == 1 and got[7]["health_score"] == pytest.approx(0.94)
    assert got[9]["garbled_ratio"] == round(9 / 11, 4) and got[9]["health_score"] == pytest.approx(0.15)
    picked = quality.plan_samples(quality.page_signals(df), F.lit("md"), ["doc_id", "page"], least=4).collect()
    assert len(picked) == 4 and {r["page"] for r in picked if r["part"] == "risk"} == {8, 9}
    results = spark.createDataFrame([(0.995, None, None), (0.8, 0.95, None), (0.99, 0.9, 0.98)], "char_accuracy double, table_f1 double, key_field_accuracy double")
    r = quality.review_report(results).collect()[0]
    assert (r["sampled"], r["passed"], r["failed"], r["pass_rate"], r["release_ok"]) == (3, 2, 1, 0.6667, False)


def page(spark, boxes, width=600.0, sizes=None, kinds=None, texts=None):
    rows = [((kinds or {}).get(i, 0), [float(v) for v in b], [([((texts or {}).get(i, f"block {i}"), float((sizes or {}).get(i, 10)))],)]) for i, b in enumerate(boxes)]
    return spark.createDataFrame([("d.pdf", 1, width, rows)], f"doc_id string, page int, width double, blocks {layout.RAW_BLOCKS}")


def order(df):
    return [r["bid"] for r in layout.reading_order(df).orderBy("read_ord").collect()]


def test_reading_orders(spark):
    assert order(page(spark, [(330, 160, 550, 180), (40, 20, 560, 50), (40, 100, 260, 120), (330, 100, 550, 120), (40, 160, 260, 180)])) == [1, 2, 4, 3, 0]
    assert order(page(spark, [(330, 80, 550, 100), (40, 80, 260, 100), (40, 160, 560, 190), (40, 220, 260, 240), (330, 220, 550, 240)])) == [1, 0, 2, 3, 4]
    assert order(page(spark, [(40, 80, 420, 100), (40, 140, 420, 160), (40, 200, 420, 220), (470, 90, 540, 110)])) == [0, 3, 1, 2]
    four = [(20 + 140 * c, 100 + 50 * r, 120 + 140 * c, 120 + 50 * r) for c in range(4) for r in range(2)]
    assert layout.detect_columns(layout.text_blocks(page(spark, four))).count() == 0
    weak = [(40, 80, 260, 100), (40, 140, 260, 160), (40, 200, 260, 220), (400, 90, 420, 110)]
    assert layout.detect_columns(layout.text_blocks(page(spark, weak, texts={3: "ab"}))).count() == 0


def test_invalid_blocks_and_headings(spark):
    df = page(spark, [(0, 0, 9, 9), (5, 5, 5, 9), (1, 1, 9, 9), (30, 30, 180, 60), (30, 70, 180, 90)], None, {4: 20}, {0: 1}, {2: " "})
    rows = layout.text_blocks(df).orderBy("bid").collect()
    assert [(r["bid"], r["type"], r["page_width"]) for r in rows] == [(3, "text", 180.0), (4, "heading", 180.0)]
    assert layout.page_markdown(df).collect()[0]["text"] == "# d.pdf\n\n## Page 1\n\nblock 3\n\n### block 4"
    assert [r["type"] for r in layout.page_blocks(df).orderBy("block_ord").collect()] == ["text", "heading"]


def test_page_text(spark):
    df = spark.createDataFrame([("记 忆 系 统， and Agent",)], "t string")
    assert df.select(layout.normalise_page_text(F.col("t"))).collect()[0][0] == "记忆系统，and Agent"

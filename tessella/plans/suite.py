"""The offline quality suite: every case is its own corpus, all cases run in one plan."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import phrases, squeeze, terms
from tessella.functions.vectors import cosine, hashed_embedding
from tessella.operators import evaluation, fusion, lexical, prompt, rerank
from tessella.operators.chunks import ChunkPolicy, chunk_documents
from tessella.operators.evaluation import Gates
from tessella.session import durable
from tessella.sources.datasets import read_cases

POLICY = ChunkPolicy(text_size=220, text_overlap=30)


def case_chunks(cases: DataFrame) -> DataFrame:
    """(query_id, chunk_id, source, content, heading_path, vector, ...) with the case in every key."""
    docs = cases.select("case_id", F.explode("documents").alias("d")).select(F.concat_ws("\x01", "case_id", "d.source").alias("doc_id"), F.col("d.content").alias("text"))
    chunks = chunk_documents(docs, POLICY)
    parts = F.split("doc_id", "\x01")
    return chunks.withColumns({"query_id": parts[0], "source": parts[1], "version": F.lit(1), "vector": hashed_embedding("content", 128)}).withColumn("doc_id", F.col("source"))


def case_lexical(chunks: DataFrame, cases: DataFrame, top_k: int) -> DataFrame:
    """BM25 and boosts with corpus statistics per case."""
    tokens = chunks.select("query_id", "chunk_id", terms("content").alias("t"), F.lower("content").alias("c"), F.lower("heading_path").alias("h"), F.lower("source").alias("s"))
    whole = Window.partitionBy("query_id")
    tokens = tokens.withColumn("dl", F.size("t")).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("avgdl", F.avg("dl").over(whole))
    asked = cases.select(F.col("case_id").alias("query_id"), terms("query").alias("qt"), phrases("query").alias("qp"))
    wanted = asked.select("query_id", F.explode("qt").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    tf = tokens.select("query_id", "chunk_id", "dl", "n", "avgdl", F.explode("t").alias("term")).groupBy("query_id", "chunk_id", "dl", "n", "avgdl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "term")))
    part = lexical.bm25(*[F.col(c) for c in ("qtf", "tf", "df", "dl", "n", "avgdl")])
    scores = tf.join(wanted, ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))
    joined = tokens.join(asked, "query_id").join(scores, ["query_id", "chunk_id"], "left")
    # Chunks without a common term count only in cases in which no chunk has one.
    found = joined.withColumn("any", F.max(F.col("bm25").isNotNull()).over(whole)).filter(F.col("bm25").isNotNull() | ~F.col("any"))
    boost = lexical.phrase_boost(F.col("qp"), F.col("c"), F.col("h"), F.col("s")) + lexical.metadata_boost(F.col("qt"), terms("h"), terms("s"))
    return lexical.rank_hits(found.select("query_id", "chunk_id", (F.coalesce("bm25", F.lit(0.0)) + boost).alias("score")).filter("score > 0"), top_k)


def run_cases(cases: DataFrame, candidates: int = 100) -> DataFrame:
    """One result row per case, without its latency."""
    chunks = durable(case_chunks(cases))
    queries = cases.select(F.col("case_id").alias("query_id"), "query", "top_k")
    asked = queries.withColumn("qv", hashed_embedding("query", 128)).select("query_id", "qv")
    near = lexical.rank_hits(chunks.join(asked, "query_id").select("query_id", "chunk_id", cosine("vector", "qv").alias("score")), candidates)
    fused = fusion.hybrid(near, case_lexical(chunks, cases, candidates), chunks, candidates)
    hits = fused.drop("source").join(chunks.drop("query_id", "vector"), "chunk_id")
    most = cases.agg(F.max("top_k")).collect()[0][0] or 3
    best = durable(rerank.rerank_pairs(hits, queries, most).join(queries.select("query_id", "top_k"), "query_id").filter("rank <= top_k"))
    answers = prompt.assemble_prompts(queries, best).withColumn("answer", prompt.extractive_answer(F.col("messages"))).select("query_id", "answer")
    evidence = best.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source", "content"))).alias("hits"),
    ).withColumn("evidence", F.array_join(F.transform("hits", lambda h: h["content"]), "\n"))
    joined = cases.withColumnRenamed("case_id", "query_id").join(answers, "query_id", "left").join(evidence, "query_id", "left")
    first = F.array_min(F.transform(F.filter("hits", lambda h: F.array_contains("relevant_sources", h["source"])), lambda h: h["rank"]))
    answer = F.coalesce(F.col("answer"), F.lit(""))
    graded = joined.withColumns({
        "first": first, "answer_term_hits": evaluation.contained_terms(answer, F.col("expected_answer_terms")), "answer_term_total": F.size("expected_answer_terms"),
        "forbidden_term_hits": evaluation.contained_terms(answer, F.col("forbidden_answer_terms")),
        "grounded_answer": F.coalesce(evaluation.is_grounded(answer, F.coalesce("evidence", F.lit(""))), F.lit(False)),
    })
    hit = lambda k: F.coalesce(F.col("first") <= k, F.lit(False))
    passed = hit(3) & (F.col("answer_term_hits") == F.col("answer_term_total")) & (F.col("forbidden_term_hits") == 0) & F.col("grounded_answer")
    return graded.select(
        F.col("query_id").alias("case_id"), "category", passed.alias("passed"), hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        "answer_term_hits", "answer_term_total", "forbidden_term_hits", "grounded_answer", "answer", F.coalesce(F.transform("hits", lambda h: h["source"]), F.array().cast("array<string>")).alias("sources"),
    )


def run_suite(spark: SparkSession, cases: DataFrame | str, gates: Gates = Gates()) -> dict[str, Any]:  # noqa: B008
    """The suite's report: results, metrics, coverage, failed gates and a digest of the cases.

    All cases share one plan, so a case's latency is the plan's time divided by their number.
    """
    table = read_cases(spark, cases) if isinstance(cases, str) else cases
    began = time.perf_counter()
    results = durable(run_cases(table))
    n = max(1, results.count())
    each = (time.perf_counter() - began) * 1000 / n
    metrics = evaluation.suite_metrics(results.withColumn("case_latency_ms", F.lit(each))).collect()[0].asDict()
    plain = sorted((r.asDict(True) for r in table.collect()), key=lambda r: r["case_id"])
    failed = gates.failed(metrics)
    return {
        "ok": not failed, "failed_gates": failed, "metrics": metrics, "thresholds": asdict(gates),
        "coverage": {r["category"]: r["cases"] for r in evaluation.coverage(table).collect()},
        "dataset_sha256": hashlib.sha256(json.dumps(plain, sort_keys=True, ensure_ascii=False).encode()).hexdigest(),
        "results": [r.asDict(True) for r in results.orderBy("case_id").collect()],
    }

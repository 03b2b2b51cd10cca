"""Retrieval metrics, their summaries, suite metrics and release gates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import squeeze


def valid_ks(wanted: Sequence[int]) -> "tuple[int, ...]":
    return tuple(sorted({int(v) for v in wanted if int(v) > 0}))


def mark_relevant(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``relevant`` by source, document or chunk id, and ``labelled``.

    ``labels``: query_id, relevant_sources, relevant_doc_ids, relevant_chunk_ids (arrays, possibly null).
    """
    joined = hits.join(labels, "query_id", "left")
    inside = lambda arr, c: F.coalesce(F.array_contains(arr, F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(False))
    any_label = reduce(lambda a, b: a | b, (F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("relevant_sources", "relevant_doc_ids", "relevant_chunk_ids")))
    relevant = inside("relevant_sources", "source") | inside("relevant_doc_ids", "doc_id") | inside("relevant_chunk_ids", "chunk_id")
    return joined.withColumn("relevant", relevant).withColumn("labelled", F.coalesce(any_label, F.lit(False)))


def _at_k(ks: tuple[int, ...], value) -> Column:  # noqa: ANN001
    return F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[value(k) for k in ks])) if ks else F.expr("map_from_arrays(array(), array())")


def retrieval_report(hits: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row per query: counts, best rank, MRR, Hit@K, Precision@K, Recall@K (of what the list holds), scores, diversity.

    ``hits``: query_id, rank, score, source, relevant. ``queries``: query_id, labelled. Numbers have 6 digits.
    """
    ks = valid_ks(ks)
    source = F.coalesce(F.col("source"), F.lit(""))
    within = [F.sum(F.when(F.col("rank") <= k, F.col("relevant").cast("int")).otherwise(0)).alias(f"__in{k}") for k in ks]
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"), F.sum(F.col("relevant").cast("int")).alias("rel"),
        F.avg("score").alias("mean"), F.max("score").alias("most"), F.countDistinct(source).alias("sources"), *within,
    )
    full = queries.select("query_id", "labelled").join(per, "query_id", "left").fillna(0, ["n", "rel", "sources", *[f"__in{k}" for k in ks]])
    got = lambda k: F.col(f"__in{k}")
    precision = lambda k: F.when(F.col("n") > 0, F.round(got(k) / F.least(F.lit(k), F.col("n")), 6)).otherwise(0.0)
    recall = lambda k: F.when(F.col("rel") > 0, F.round(got(k) / F.col("rel"), 6)).otherwise(0.0)
    maps = {"hit_at_k": lambda k: got(k) > 0, "precision_at_k": precision, "recall_at_k": recall}
    best = F.when(F.col("labelled"), F.col("best"))
    return full.select(
        "query_id", "labelled", F.col("n").cast("bigint").alias("candidate_count"), best.cast("int").alias("best_rank"), F.coalesce(F.round(1 / best, 6), F.lit(0.0)).alias("mrr"),
        *[F.when(F.col("labelled"), _at_k(ks, v)).alias(name) for name, v in maps.items()],
        F.coalesce(F.round("mean", 6), F.lit(0.0)).alias("mean_score"), F.coalesce(F.round("most", 6), F.lit(0.0)).alias("max_score"),
        F.when(F.col("n") > 0, F.round(F.col("sources") / F.col("n"), 6)).otherwise(0.0).alias("source_diversity"),
    )


def summarise_reports(reports: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row over all reports; metrics average over the labelled ones only."""
    ks = valid_ks(ks)
    labelled = F.col("labelled")
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(labelled, c)), 6), F.lit(0.0))
    at = lambda name: _at_k(ks, lambda k: mean(F.element_at(F.col(name), k).cast("double")))
    return reports.agg(
        F.count(F.lit(1)).alias("query_count"), F.coalesce(F.sum(labelled.cast("bigint")), F.lit(0)).alias("labelled_query_count"),
        F.coalesce(F.round(F.avg("candidate_count"), 6), F.lit(0.0)).alias("average_candidate_count"), mean(F.col("mrr")).alias("average_mrr"),
        at("hit_at_k").alias("hit_rate_at_k"), at("precision_at_k").alias("average_precision_at_k"), at("recall_at_k").alias("average_recall_at_k"),
    )


@dataclass(frozen=True)
class Gates:
    """Release gates: what a suite's metrics must reach or not exceed."""

    max_p95_case_latency_ms: float = 250.0
    min_mrr: float = 0.85
    max_forbidden_term_violation_rate: float = 0.0
    min_hit_rate_at_1: float = 0.75
    min_grounded_answer_rate: float = 1.0
    min_hit_rate_at_3: float = 1.0
    min_case_pass_rate: float = 1.0
    min_answer_term_recall: float = 1.0

    @classmethod
    def load(cls, source: str | Mapping[str, float]) -> Gates:
        """From a mapping or a JSON text; unknown names and values out of range are errors."""
        values = json.loads(source) if isinstance(source, str) else source
        if not isinstance(values, Mapping):
            raise ValueError("gates must be a JSON object")
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown gates: {unknown}")
        for name, v in values.items():
            v = float(v)
            if v < 0 or (v > 1 and not name.endswith("_ms")):
                raise ValueError(f"{name} is out of range: {v}")
        return cls(**{k: float(v) for k, v in values.items()})

    def failed(self, metrics: Mapping[str, float]) -> list[str]:
        out = []
        for name, limit in asdict(self).items():
            got = metrics[name[4:]]
            if (got < limit) if name.startswith("min_") else (got > limit):
                out.append(name)
        return out


def gate_check(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(name, value, actual, failed): ``metrics``(metric, actual) against ``gates``(name, value)."""
    joined = gates.withColumn("metric", F.substring("name", 5, 1000)).join(metrics, "metric")
    failed = F.when(F.col("name").startswith("min_"), F.col("actual") < F.col("value")).otherwise(F.col("actual") > F.col("value"))
    return joined.select("name", "value", "actual", failed.alias("failed"))


def suite_metrics(results: DataFrame) -> DataFrame:
    """One row of the eight suite metrics over case results; no cases count as passed, with latency 0."""
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(1.0))
    metrics = {
        "case_pass_rate": rate(F.col("passed")),
        "hit_rate_at_1": rate(F.col("hit_at_1")),
        "hit_rate_at_3": rate(F.col("hit_at_3")),
        "mrr": F.coalesce(F.avg("reciprocal_rank"), F.lit(1.0)),
        "answer_term_recall": F.coalesce(F.try_divide(F.sum("answer_term_hits"), F.sum("answer_term_total")), F.lit(1.0)),
        "grounded_answer_rate": rate(F.col("grounded_answer")),
        "forbidden_term_violation_rate": rate(F.col("forbidden_term_hits") > 0),
        "p95_case_latency_ms": F.coalesce(F.expr("percentile_disc(0.95) within group (order by case_latency_ms)"), F.lit(0.0)),
    }
    return results.agg(*[F.round(c, 6).alias(name) for name, c in metrics.items()])


def coverage(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("cases")).orderBy("category")


def contained_terms(text: Column, wanted: Column) -> Column:
    """How many of the wanted terms the text holds, white space and case apart."""
    plain = squeeze(text)
    return F.size(F.filter(wanted, lambda t: F.contains(plain, squeeze(t))))


def is_grounded(answer: Column, evidence: Column) -> Column:
    """Whether a non-empty answer stands in the evidence."""
    return (squeeze(answer) != "") & F.contains(squeeze(evidence), squeeze(answer))

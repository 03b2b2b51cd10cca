"""Reciprocal rank fusion, source diversity and parent expansion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.lexical import rank_hits


@dataclass(frozen=True)
class FusionConfig:
    rank_offset: int = 60
    lexical_weight: float = 1.5
    vector_weight: float = 1.0
    score_share: float = 0.05
    diversity_penalty: float = 0.01


def chunk_key(chunk_id: Column, doc_id: Column, source: Column, chunk_index: Column) -> Column:
    """The chunk id, or document and position where it is empty."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(chunk_id), F.concat(F.coalesce(blank(doc_id), blank(source), F.lit("")), F.lit("::"), F.coalesce(chunk_index.cast("string"), F.lit(""))))


def fuse(channels: list[tuple[DataFrame, float]], config: FusionConfig = FusionConfig()) -> DataFrame:  # noqa: B008
    """(query_id, chunk_id, score, first_seen) of ranked channels (query_id, chunk_id, score, rank) and their weights.

    Each hit adds weight / (rank_offset + rank) and a share of its score relative to the channel's largest magnitude.
    ``first_seen`` orders ties: earlier channels first, then rank.
    """
    parts = []
    for i, (hits, weight) in enumerate(channels):
        most = F.max(F.abs("score")).over(Window.partitionBy("query_id"))
        top = F.when(most == 0, F.lit(1.0)).otherwise(most)
        points = F.lit(weight) / (F.lit(config.rank_offset) + F.col("rank")) + F.lit(weight * config.score_share) * F.col("score") / top
        parts.append(hits.select("query_id", "chunk_id", points.alias("points"), F.struct(F.lit(i).alias("channel"), F.col("rank").cast("int").alias("rank")).alias("seen")))
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy("query_id", "chunk_id").agg(F.sum("points").alias("score"), F.min("seen").alias("first_seen"))


def diversify(hits: DataFrame, top_k: int, penalty: float = FusionConfig.diversity_penalty, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rank hits (score, source, first_seen) with ``penalty`` off for each earlier hit of the source; scores stay as they are.

    The greedy choice equals sorting by score - penalty x (place within the source), for penalty >= 0.
    """
    source = F.coalesce(F.col("source"), F.lit(""))
    within = F.row_number().over(Window.partitionBy(*keys, source).orderBy(F.desc("score"), "first_seen", "chunk_id")) - 1
    adjusted = hits.withColumn("__adjusted", F.col("score") - F.lit(penalty) * within)
    order = Window.partitionBy(*keys).orderBy(F.desc("__adjusted"), F.desc("score"), "first_seen", "chunk_id")
    return adjusted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("__adjusted")


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, chunks: DataFrame, top_k: int, config: FusionConfig = FusionConfig()) -> DataFrame:  # noqa: B008
    """(query_id, chunk_id, score, first_seen, source, rank) of both channels."""
    fused = fuse([(vector_hits, config.vector_weight), (lexical_hits, config.lexical_weight)], config)
    return diversify(fused.join(chunks.select("chunk_id", "source"), "chunk_id", "left"), top_k, config.diversity_penalty)


def expand_parents(hits: DataFrame, parents: DataFrame, top_k: int) -> DataFrame:
    """Children give way to their parents, each with its best child's score; a child without a known parent stays itself.

    ``hits``: query_id, chunk_id, parent_id, content, score. ``parents``: chunk_id, content.
    """
    group = F.coalesce("parent_id", "chunk_id")
    best = hits.groupBy("query_id", group.alias("group")).agg(F.max_by(F.struct("chunk_id", "content", "score", "parent_id"), F.struct("score", "chunk_id")).alias("child"))
    known = parents.select(F.col("chunk_id").alias("pid"), F.col("content").alias("parent_content"))
    joined = best.join(known, F.col("child.parent_id") == F.col("pid"), "left")
    out = joined.select("query_id", F.coalesce("pid", "child.chunk_id").alias("chunk_id"), F.coalesce("parent_content", "child.content").alias("content"), F.col("child.score").alias("score"))
    return rank_hits(out, top_k)

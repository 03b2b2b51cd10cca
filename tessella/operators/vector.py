"""Exact cosine search of a set of query vectors over all vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.operators.filters import filter_column
from tessella.operators.lexical import rank_hits

#: Query vectors up to this many numbers are broadcast; beyond it the queries are cut into blocks of that size.
BROADCAST_NUMBERS = 4_000_000


def vector_search(chunks: DataFrame, queries: DataFrame, top_k: int, conditions: Mapping[str, Any] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for ``chunks``(chunk_id, vector) and ``queries``(query_id, vector)."""
    allowed = chunks.filter(filter_column(chunks, conditions)) if conditions else chunks
    some = allowed.filter(F.size("vector") > 0).select("chunk_id", "vector")
    if top_k <= 0:
        return some.select(F.lit("").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    asked = queries.select("query_id", F.col("vector").alias("qv"))
    pairs = some.join(asked, F.lit(True), "cross")
    return rank_hits(pairs.select("query_id", "chunk_id", cosine("vector", "qv").alias("score")), top_k)


def block_search(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """As ``vector_search`` for numeric ids and vectors of one length, block against block in matrix products.

    Queries travel in the tasks' closures, block by block, so memory stays bounded; every task returns its own best
    ``top_k`` per query, and only those are shuffled.
    """
    asked = queries.select("query_id", "vector").toPandas()
    if not len(asked) or top_k <= 0:
        return vector_search(chunks, queries, 0)
    width = max(len(v) for v in asked["vector"])
    step = max(1, BROADCAST_NUMBERS // max(1, width))
    parts = [_block(chunks, asked.iloc[i : i + step], top_k) for i in range(0, len(asked), step)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return rank_hits(found, top_k)


def _block(chunks: DataFrame, asked: pd.DataFrame, top_k: int) -> DataFrame:
    ids, q = asked["query_id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in asked["vector"]])
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    q = q / np.where(norms == 0, 1.0, norms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(q)
        for b in batches:
            x = np.stack([np.asarray(v, np.float64) for v in b["vector"]])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            sims = q @ (x / np.where(n == 0, 1.0, n)).T
            chunk = b["chunk_id"].to_numpy()
            for i in range(len(q)):
                s, c = np.concatenate([held[i][0], sims[i]]), np.concatenate([held[i][1], chunk])
                keep = np.lexsort((c, -s))[:top_k]
                held[i] = (s[keep], c[keep])
        for i, (s, c) in enumerate(held):
            if len(s):
                yield pd.DataFrame({"query_id": np.full(len(s), ids[i]), "chunk_id": c, "score": s})

    some = chunks.filter(F.size("vector") > 0).select("chunk_id", "vector")
    return some.mapInPandas(run, "query_id bigint, chunk_id bigint, score double")

"""Reproducible global shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered 0..n-1 in the order of (hash bucket, key, size, checksum), by a count per bucket and a number within
it, so no task ever sorts the whole table; rows that are equal are numbered as one group with its count, so a third
of the table that is equal is one row until its numbers are dealt out. A Feistel network over a x b >= n mixes the numbers, with
b = ceil(n / a), a = ceil(sqrt(n)); what lands at n or above walks its cycle on until it is below, at most
a*b - n < a times, so the result is a permutation of 0..n-1. Shard and slot follow by arithmetic, and the inverse
permutation gives the row of any (shard, slot). DataFrame functions only.

Defined results: a null text has 0 bytes; a null key is numbered like any value; repeated rows are interchangeable;
an empty table stays empty. Only the key and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import equal_groups, expand_groups, group_sizes, number_groups, text_or_empty

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1 if n > 1 else 1)
    return a, max(1, -(-n // a))


def _pass(x: Column, n: int, seed: int, inverse: bool) -> Column:
    """One pass of the network over 0..a*b-1; the pair (left, right) is folded as one struct per round."""
    a, b = grid(n)

    def step(acc: Column, k: Column) -> Column:
        sign = -1 if inverse else 1
        left, right = acc["l"], acc["r"]
        odd = F.pmod(k, F.lit(2)) == 1
        to_left = F.pmod(left + sign * F.pmod(F.xxhash64(right, k, F.lit(seed)), F.lit(a)), F.lit(a))
        to_right = F.pmod(right + sign * F.pmod(F.xxhash64(left, k, F.lit(seed)), F.lit(b)), F.lit(b))
        return F.struct(F.when(odd, to_left).otherwise(left).alias("l"), F.when(odd, right).otherwise(to_right).alias("r"))

    rounds = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)
    start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in rounds]), start, step, lambda acc: acc["l"] * F.lit(b) + acc["r"])


def feistel(x: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """A permutation of 0..n-1 applied to ``x`` (bigint), cycles walked."""
    a, b = grid(n)
    once = _pass(x, n, seed, inverse)
    spare = a * b - n
    if not spare:
        return once
    # Outside rows, one in sqrt(n), walk on; no cycle holds more than `spare` outside numbers, so the walk ends.
    steps = F.when(once < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(spare)))
    return F.aggregate(steps, once, lambda y, _: F.when(y < n, y).otherwise(_pass(y, n, seed, inverse)))


def shard_rows(rows: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Add shard (0..shards-1, counts at most one apart) and slot (gapless from 0) to every row; all columns must be orderable."""
    groups = equal_groups(rows)
    n, most = group_sizes(groups)
    numbered = expand_groups(number_groups(groups, [], n), most)
    place = numbered.withColumn("__place", feistel(F.col("__first") + F.col("__nth"), n, seed))
    return place.select(*rows.columns, F.pmod("__place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("__place") / shards).cast("bigint").alias("slot"))


def shard_documents(df: DataFrame, shards: int = 24, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each document under the law of equal row counts."""
    t = text_or_empty(text)
    narrow = df.select(key, (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    return shard_rows(narrow, shards, seed)

"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target: its share by weight of a budget (a multiple of all words), stopped at ``repeats`` times
its size, the excess shared again. Its documents stand in a queue in hash order, once for each allowed repeat, the
second pass behind the first. A document's virtual finish time is the cumulative words of its source divided by the
source's target. All queues are merged in the order of finish times, and the mix is cut where the budget is reached.
The sums within a source are taken in buckets of the hash, whose number follows the number of rows. Of the merged order
only the sums of slices of the finish time are needed, and the order inside the one slice in which the budget is
reached: slices before it are taken whole, slices behind it not at all, however many rows they hold.

Defined results: a null text has no words; a null source is a source, the last; a source without words has target 0;
repeated rows queue separately; reruns agree, as order depends on hashes of the rows alone; without any words all
rows are taken. Only the key, source and text columns are read. Sources are one row each in a single task, sorted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import BUCKET_ROWS, WORD, equal_groups, expand_groups, group_sizes, text_or_empty
from tessella.session import discard, durable

WEIGHTS = (5, 2, 1)


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def source_targets(rows: DataFrame, budget_share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, rank, target, budget) per source of ``rows``(source, size): one row each."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    every = Window.partitionBy()
    capped = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * repeats).withColumn("budget", F.sum("source_size").over(every) * F.lit(budget_share))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # If all sources before this one are full, the rest shares at this level; the true level is the highest of these.
    level = F.max("level").over(every)
    return (
        capped.withColumn("level", (F.col("budget") - filled) / open_weight)
        .withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
        .select("source", "source_size", "rank", "target", "budget")
    )


def mix_rows(rows: DataFrame, budget_share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, source, size, occurrence, source_size, target, takes) of stored ``rows``(key, source, size, occurrence)."""
    sources = source_targets(rows, budget_share, repeats, weights)
    n = rows.count() * repeats
    digits, slices = 2, max(256, -(-n // BUCKET_ROWS))
    while n >> (4 * digits) > BUCKET_ROWS:
        digits += 1
    name = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("size").cast("string"), F.col("occurrence").cast("string")).cast("binary"))
    queued = rows.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(repeats)]))).withColumn("h", name)
    queued = queued.withColumn("bucket", F.concat(F.col("epoch").cast("string"), F.substring("h", 1, digits)))
    same = F.col("q.source").eqNullSafe(F.col("s.source"))

    per_bucket = queued.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("source", "bucket", F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("base"))
    bases = bases.alias("q").join(sources.alias("s"), same).select("q.source", "bucket", "base", "source_size", "rank", "target", "budget")
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col(key).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = queued.withColumn("within", F.sum("size").over(inside))
    timed = (
        summed.alias("q")
        .join(bases.alias("s"), same & (F.col("q.bucket") == F.col("s.bucket")))
        .select("q." + key, "q.source", "size", "occurrence", "epoch", "h", "source_size", "rank", "target", "budget", (F.col("base") + F.col("within")).alias("cum"))
        .withColumn("finish", F.when(F.col("target") > 0, F.col("cum") / F.col("target")).otherwise(F.lit(0.0)))
        .withColumn("slice", F.when(F.col("finish") < 2, F.floor(F.col("finish") * slices)).otherwise(2 * slices + F.floor(F.log2(F.col("finish") / 2) * slices)))
    )
    timed = durable(timed)
    # One row a slice: finish times from 2 on stand on a logarithmic scale, so slices stay few however late a queue ends.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = timed.groupBy("slice", "budget").agg(F.sum("size").alias("part")).withColumn("start", F.coalesce(F.sum("part").over(before), F.lit(0)))
    over = sums.filter(F.col("start") + F.col("part") > F.col("budget")).agg(F.min("slice").alias("edge"), F.min("start").alias("start")).collect()[0]
    if over["edge"] is None:
        cut = timed.withColumn("take", F.lit(True))
    else:
        merged = Window.partitionBy("slice").orderBy("finish", "rank", "epoch", "h", F.col(key).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
        inside = timed.filter(F.col("slice") == over["edge"]).withColumn("take", F.lit(over["start"]) + F.sum("size").over(merged) <= F.col("budget"))
        cut = timed.filter(F.col("slice") != over["edge"]).withColumn("take", F.col("slice") < over["edge"]).unionByName(inside)
    taken = F.sum(F.col("take").cast("int"))
    return cut.groupBy(key, "source", "size", "occurrence").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), taken.alias("takes"))


def count_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, occurrence), stored: equal rows are told apart by their occurrence."""
    groups = equal_groups(df.select(F.col(key), F.col(source).alias("source"), word_count(text).alias("size")))
    expanded = expand_groups(groups, group_sizes(groups)[1])
    rows = durable(expanded.select(key, "source", "size", (F.col("__nth") + 1).cast("int").alias("occurrence")))
    discard(groups)
    return rows


def mix_documents(df: DataFrame, budget_share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, source_size, target, takes, taken): how often and for how many words the mix takes each row."""
    mixed = mix_rows(count_rows(df, key, source, text), budget_share, repeats, weights, seed, key)
    return mixed.withColumn("taken", F.col("takes") * F.col("size"))

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import durable

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LETTERS = re.compile(r"[^\W\d_]+")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters; numerals that Python also counts as word characters may be inside."""
    return _LETTERS.findall(text.lower())


def bounded_sample(rows: DataFrame, per_group: int, by: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """At most ``per_group`` different rows of ``rows``(k, t, <by>) for each value of ``by``, and at most ``most`` in all.

    Those of the lowest hashes are taken; rows that repeat are one. The choice is made on hashes alone, with the rank
    limited on both sides of the shuffle; the texts of the chosen rows are read after it.
    """
    mark = F.xxhash64("t").alias("h")
    order = [F.xxhash64("k"), F.col("k"), F.col("h")]
    narrow = rows.select("k", *by, mark).distinct()
    if by:
        low = narrow.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= per_group)
        low = (low.orderBy("r", *by).limit(most) if most else low).drop("r")
    else:
        low = narrow.orderBy(*order).limit(per_group)
    found = rows.select("k", *by, "t", mark).join(F.broadcast(low), ["k", *by, "h"])
    # A bounded sample is small enough to be merged into one task; spread, its texts are taken apart by all.
    return found.dropDuplicates(["k", *by, "h"]).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "h").drop("h")


#: Rows of one window partition that numbers rows, and of one piece of a group of equal rows.
BUCKET_ROWS, PIECE_ROWS = 1 << 16, 1 << 14


def equal_groups(rows: DataFrame) -> DataFrame:
    """The different rows with their counts (``__count``), stored: however many rows are equal, each task sends one."""
    return durable(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__count")))


def number_groups(groups: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """Add ``__first`` to ``equal_groups``: the number, from 0, of a group's first row among the rows that agree in ``by``.

    The order is that of a hash bucket, then the columns; buckets follow the number of ``rows``, so no window grows with it.
    """
    columns = [c for c in groups.columns if c != "__count"]
    rest = [c for c in columns if c not in by]
    bucket = F.pmod(F.xxhash64(*rest), F.lit(max(64, -(-rows // BUCKET_ROWS)))).cast("int") if rest else F.lit(0)
    held = groups.withColumn("__bucket", bucket)
    ahead = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = held.groupBy(*by, "__bucket").agg(F.sum("__count").alias("__n"))
    bases = per.select(*by, "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in rest]).rowsBetween(Window.unboundedPreceding, -1)
    within = held.withColumn("__in", F.coalesce(F.sum("__count").over(inside), F.lit(0)))
    same = F.col("a.__bucket") == F.col("b.__bucket")
    for c in by:
        same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    joined = within.alias("a").join(bases.alias("b"), same)
    return joined.select(*[F.col(f"a.`{c}`") for c in columns], "__count", (F.col("__base") + F.col("__in")).alias("__first"))


def expand_groups(groups: DataFrame, most: int) -> DataFrame:
    """Each row as often as its ``__count`` says, numbered 0, 1, ... in ``__nth``; ``most``: the largest count.

    Groups beyond a piece are cut into pieces that are spread over the tasks before they become rows.
    """

    def piece(df: DataFrame, at: Column) -> DataFrame:
        end = F.least(F.col("__count"), at + PIECE_ROWS) - 1
        return df.withColumn("__nth", F.explode(F.sequence(at, end)))

    zero = F.lit(0).cast("bigint")
    out = piece(groups.filter(F.col("__count").between(1, PIECE_ROWS)), zero)
    if most > PIECE_ROWS:
        many = groups.filter(F.col("__count") > PIECE_ROWS)
        cut = many.withColumn("__at", F.explode(F.sequence(zero, F.col("__count") - 1, F.lit(PIECE_ROWS).cast("bigint"))))
        spread = cut.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("__at", *groups.columns))
        out = out.unionByName(piece(spread, F.col("__at")).drop("__at"))
    return out


def group_sizes(groups: DataFrame) -> tuple[int, int]:
    """(rows, largest count) of ``equal_groups``."""
    total = groups.agg(F.coalesce(F.sum("__count"), F.lit(0)).alias("n"), F.coalesce(F.max("__count"), F.lit(0)).alias("m")).collect()[0]
    return total["n"], total["m"]

"""Markdown text to structural blocks, as gaps and islands over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import split_lines, trim_blank

_FENCE = "(?U)^```(\\w*)\\s*$"
_HEADING = "(?U)^(#{1,6})\\s+(.*)$"
_ROW = "(?U)^\\s*\\|.*\\|\\s*$"
_IMAGE = '(?U)^\\s*!\\[([^\\]]*)\\]\\((\\S+?)(?:\\s+"([^"]*)")?\\)\\s*$'

KINDS = ("heading", "code", "table", "image", "text")


def image_text(alt: Column, title: Column, target: Column) -> Column:
    """Searchable text of an image: what is known of its caption, title and path, by line."""
    part = lambda label, c: F.when(trim_blank(c) != "", F.concat(F.lit(label), trim_blank(c)))
    joined = F.concat_ws("\n", part("图片/图表: ", alt), part("标题: ", title), part("路径: ", target))
    return F.when(joined == "", F.lit("图片/图表")).otherwise(joined)


def classify_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ln, line, kind, fence, code_no): the kind of each line, a fence's lines being code."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(split_lines(text)).alias("ln", "line"))
    so_far = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    fenced = lines.withColumn("fence", trim_blank("line").rlike(_FENCE).cast("int")).withColumn("seen", F.sum("fence").over(so_far))
    code = (F.col("fence") == 1) | (F.col("seen") % 2 == 1)
    kind = (
        F.when(code, "code")
        .when(F.col("line").rlike(_HEADING), "heading")
        .when(F.col("line").rlike(_ROW), "table")
        .when(F.col("line").rlike(_IMAGE), "image")
        .otherwise("text")
    )
    return fenced.select("doc_id", "ln", "line", kind.alias("kind"), "fence", "seen", F.when(code, F.floor((F.col("seen") + 1) / 2)).alias("code_no"))


def parse_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, block_ord, type, text, level, lang, start_line, end_line, page, bbox, confidence)."""
    order = Window.partitionBy("doc_id").orderBy("ln")
    lines = classify_lines(docs, doc_id, text)
    before = F.lag("kind").over(order)
    starts = before.isNull() | F.col("kind").isin("heading", "image") | (before != F.col("kind")) | ((F.col("kind") == "code") & ~F.lag("code_no").over(order).eqNullSafe(F.col("code_no")))
    numbered = lines.withColumn("block", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("fence") == 0, F.struct("ln", "line")))), lambda x: x["line"])
    first, last = F.min(F.struct("ln", "line")), F.max(F.struct("ln", "seen"))
    blocks = numbered.groupBy("doc_id", "block", "kind").agg(body.alias("body"), first.alias("first"), last.alias("last"), F.sum("fence").alias("fences"))
    line = F.col("first.line")
    joined = F.array_join("body", "\n")
    content = (
        F.when(F.col("kind") == "heading", trim_blank(F.regexp_extract(line, _HEADING, 2)))
        .when(F.col("kind") == "image", image_text(F.regexp_extract(line, _IMAGE, 1), F.regexp_extract(line, _IMAGE, 3), F.regexp_extract(line, _IMAGE, 2)))
        .when(F.col("kind") == "text", trim_blank(joined))
        .otherwise(joined)
    )
    # A fence that nothing closes runs to the end and counts the line behind it.
    unclosed = ((F.col("kind") == "code") & (F.col("last.seen") % 2 == 1)).cast("int")
    shaped = blocks.select(
        "doc_id", "block", F.col("kind").alias("type"), content.alias("text"),
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, _HEADING, 1))).otherwise(0).alias("level"),
        F.when(F.col("kind") == "code", F.regexp_extract(trim_blank(line), _FENCE, 1)).otherwise("").alias("lang"),
        F.col("first.ln").alias("start_line"), (F.col("last.ln") + 1 + unclosed).alias("end_line"),
    ).filter((F.col("type") != "text") | (F.col("text") != ""))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1
    return shaped.select(
        "doc_id", place.cast("int").alias("block_ord"), "type", "text", "level", "lang", "start_line", "end_line",
        F.lit(0).alias("page"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(1.0).alias("confidence"),
    )


def with_heading_path(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add the headings in force at each block, joined by `` > ``: a level counts while no later heading is above it."""
    frame = Window.partitionBy(*keys).orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when((F.col("type") == "heading") & (F.col("level") == n), F.struct("block_ord", "text")), ignorenulls=True).over(frame) for n in range(1, 7)]
    held = blocks.withColumns({f"__h{n}": c for n, c in enumerate(latest, 1)})
    parts, above = [], F.lit(-1)
    for n in range(1, 7):
        at = F.col(f"__h{n}.block_ord")
        parts.append(F.when(at > above, F.col(f"__h{n}.text")))
        above = F.greatest(above, F.coalesce(at, F.lit(-1)))
    return held.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*[f"__h{n}" for n in range(1, 7)])

"""PDF page geometry: headings by font size, columns by gaps, and the reading order, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import trim_blank

RAW_BLOCKS = "array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>"
HEADING_RATIO, SPAN_RATIO, GAP_RATIO, MIN_GAP, MAX_COLUMNS, MIN_SUPPORT, MIN_CHARS = 1.2, 0.62, 0.035, 18.0, 3, 0.18, 40


def valid_bbox(b: Column) -> Column:
    """Four finite numbers that span an area."""
    finite = F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(b) == 4) & finite & (F.try_element_at(b, F.lit(3)) > b[0]) & (F.try_element_at(b, F.lit(4)) > F.try_element_at(b, F.lit(2))), F.lit(False))


def _spans(lines: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(lines, F.array().cast("array<struct<spans:array<struct<text:string,size:double>>>>")), lambda x: F.coalesce(x["spans"], F.array().cast("array<struct<text:string,size:double>>"))))


def block_text(lines: Column) -> Column:
    """Spans of a line put together, lines trimmed, blank ones dropped."""
    texts = F.transform(lines, lambda x: trim_blank(F.array_join(F.transform(x["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")))
    return trim_blank(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))


def median_font_size(blocks: Column) -> Column:
    """The upper median of all spans' sizes; 0 without spans."""
    sizes = F.array_sort(F.filter(F.transform(F.flatten(F.transform(blocks, lambda b: _spans(b["lines"]))), lambda s: s["size"]), lambda x: x.isNotNull()))
    return F.coalesce(F.try_element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")), F.lit(0.0))


def text_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, page_width, bid, x0, y0, x1, y1, text, type, level) of ``pages``(doc_id, page, width, blocks)."""
    sized = pages.withColumn("__median", median_font_size(F.col("blocks")))
    one = sized.select("doc_id", "page", "width", "__median", F.posexplode("blocks").alias("bid", "b"))
    one = one.withColumn("text", block_text(F.col("b.lines"))).filter((F.col("b.type") == 0) & valid_bbox(F.col("b.bbox")) & (F.col("text") != ""))
    largest = F.coalesce(F.array_max(F.transform(_spans(F.col("b.lines")), lambda s: s["size"])), F.lit(0.0))
    heading = (F.col("__median") > 0) & (largest >= F.col("__median") * HEADING_RATIO)
    edges = [F.col("b.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    out = one.select("doc_id", "page", "width", "bid", *edges, "text", F.when(heading, "heading").otherwise("text").alias("type"), heading.cast("int").alias("level"))
    whole = Window.partitionBy("doc_id", "page")
    width = F.coalesce(F.when(F.col("width") > 0, F.col("width")), F.max("x1").over(whole), F.lit(1.0))
    return out.withColumn("page_width", width).drop("width")


def detect_columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, col_no, cx0, cx1) of pages with two or three supported columns; others have no row."""
    keys = ("doc_id", "page")
    candidates = blocks.filter((F.col("type") != "heading") & (F.length("text") >= 2) & (F.col("x1") - F.col("x0") <= F.col("page_width") * SPAN_RATIO))
    order = Window.partitionBy(*keys).orderBy("x0", "bid")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.greatest(F.col("page_width") * GAP_RATIO, F.lit(MIN_GAP))
    swept = candidates.withColumn("__new", (F.coalesce(F.col("x0") - reach > gap, F.lit(True))).cast("int")).withColumn("__total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    clustered = swept.withColumn("col_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    columns = clustered.filter("__total >= 4").groupBy(*keys, "col_no").agg(F.min("x0").alias("cx0"), F.max("x1").alias("cx1"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    page = Window.partitionBy(*keys)
    need = F.greatest(F.lit(MIN_CHARS), F.floor(F.max("chars").over(page) * F.lit(MIN_SUPPORT)))
    weak = ((F.col("n") < 2) & (F.col("chars") < need)).cast("int")
    judged = columns.withColumn("__weak", weak).withColumn("__any", F.max("__weak").over(page)).withColumn("__cols", F.count(F.lit(1)).over(page))
    return judged.filter((F.col("__any") == 0) & F.col("__cols").between(2, MAX_COLUMNS)).select(*keys, F.col("col_no").cast("int").alias("col_no"), "cx0", "cx1")


def reading_order(pages: DataFrame) -> DataFrame:
    """Blocks with ``read_ord``: full-width blocks cut a columnar page in bands, read column by column."""
    keys = ["doc_id", "page"]
    blocks = text_blocks(pages)
    columns = detect_columns(blocks).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col_no", "cx0", "cx1"))).alias("cols"))
    held = blocks.join(columns, keys, "left").withColumn("__many", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    columnar = F.col("cols").isNotNull() & (F.col("__many") >= 4)
    overlaps = F.size(F.filter("cols", lambda c: F.greatest(F.lit(0.0), F.least(F.col("x1"), c["cx1"]) - F.greatest(F.col("x0"), c["cx0"])) >= (c["cx1"] - c["cx0"]) * 0.25))
    spanning = (F.col("x1") - F.col("x0") >= F.col("page_width") * SPAN_RATIO) | (overlaps > 1)
    center = (F.col("x0") + F.col("x1")) / 2
    nearest = F.array_min(F.transform("cols", lambda c: F.struct(F.when(center.between(c["cx0"], c["cx1"]), 0.0).otherwise(F.least(F.abs(center - c["cx0"]), F.abs(center - c["cx1"]))).alias("d"), c["col_no"].alias("n"))))
    placed = held.withColumn("__span", columnar & spanning).withColumn("__col", F.when(columnar & ~spanning, nearest["n"]).otherwise(0))
    # Spans in (y, x) order; a block belongs to the band behind all spans that do not lie below it.
    by_y = Window.partitionBy(*keys).orderBy("y0").rangeBetween(Window.unboundedPreceding, 0)
    spans = Window.partitionBy(*keys, "__span").orderBy(F.round("y0", 2), F.round("x0", 2), "bid")
    band = F.when(F.col("__span"), F.row_number().over(spans) - 1).otherwise(F.sum(F.col("__span").cast("int")).over(by_y))
    keyed = placed.withColumn("__band", F.when(columnar, band).otherwise(0)).withColumn("__after", F.col("__span").cast("int"))
    order = Window.partitionBy(*keys).orderBy("__band", "__after", "__col", F.round("y0", 2), F.round("x0", 2), "bid")
    return keyed.select(*keys, (F.row_number().over(order) - 1).alias("read_ord"), "bid", "x0", "y0", "x1", "y1", "text", "type", "level", "page_width")


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks in reading order in the shape that ``chunk_blocks`` takes."""
    ordered = reading_order(pages)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "read_ord")) - 1
    return ordered.select(
        "doc_id", place.cast("int").alias("block_ord"), "type", "text", "level", F.lit("").alias("lang"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"),
        "page", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.lit(1.0).alias("confidence"),
    )


_PUNCT = "、。，：；！？《》（）‘’“”"
_CLUSTER = f"\\u4e00-\\u9fff{_PUNCT}"


def normalise_page_text(c: Column) -> Column:
    """No white space inside runs of CJK characters and none behind CJK punctuation."""
    joined = F.regexp_replace(trim_blank(c), f"(?U)(?<=[{_CLUSTER}])\\s+(?=[{_CLUSTER}])", "")
    return F.regexp_replace(joined, f"(?U)(?<=[{_PUNCT}])\\s+(?=\\S)", "")


def page_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, text): a title, then each page under its own heading, headings of the page one level deeper."""
    ordered = reading_order(pages).withColumn("__t", normalise_page_text(F.col("text"))).filter(F.col("__t") != "")
    line = F.when(F.col("type") == "heading", F.concat(F.lit("### "), F.col("__t"))).otherwise(F.col("__t"))
    per = ordered.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_ord", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("body"))
    body = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.col("body"))
    whole = per.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("pages"))
    name = F.element_at(F.split("doc_id", "/"), -1)
    return whole.select("doc_id", F.concat(F.lit("# "), name, F.lit("\n\n"), F.col("pages")).alias("text"))

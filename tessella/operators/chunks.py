"""Blocks to traceable chunks: sentence packing, code and table splitting, parent and child chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import let, split_lines, token_estimate, trim_blank
from tessella.operators.blocks import parse_blocks, with_heading_path


@dataclass(frozen=True)
class ChunkPolicy:
    text_size: int = 512
    text_overlap: int = 80
    min_chunk: int = 40
    hard_max: int = 1200
    code_size: int = 800
    table_size: int = 1000


_NONE = "array<string>"
_DEFINITION = "(?U)^\\s*(?:" + "|".join(sorted("private public function func class def".split())) + ") "


def pack_sentences(text: Column, size: int, overlap: int) -> Column:
    """Pieces of a text: whole if it fits, else sentences packed greedily, each piece repeating the last ones for at least ``overlap``.

    The fold runs over sentence numbers, so that its state never holds text.
    """
    span = "array<struct<a:int,b:int>>"

    def pack(held: Column) -> Column:
        sentences, costs = held["s"], held["c"]

        def back(state: Column, i: Column) -> Column:
            """Walk back from the sentence before ``i`` to the one at which the overlap is reached; at least one."""
            return F.aggregate(
                F.sequence(i - 1, state["a"], F.lit(-1)),
                F.struct(i.alias("a"), F.lit(0).alias("n")),
                lambda w, j: F.when((w["n"] >= overlap) & (w["a"] < i), w).otherwise(F.struct(j.alias("a"), (w["n"] + F.element_at(costs, j)).alias("n"))),
            )

        def step(state: Column, i: Column) -> Column:
            cost = F.element_at(costs, i)
            cut = F.concat(state["out"], F.array(F.struct(state["a"].alias("a"), (i - 1).alias("b"))))
            moved = let(back(state, i), lambda w: F.struct(cut.alias("out"), w["a"].alias("a"), (w["n"] + cost).alias("n")))
            return F.when((i > 1) & (state["n"] + cost > size), moved).otherwise(F.struct(state["out"].alias("out"), state["a"].alias("a"), (state["n"] + cost).alias("n")))

        ranges = F.aggregate(
            F.sequence(F.lit(1), F.size(sentences)),
            F.struct(F.array().cast(span).alias("out"), F.lit(1).alias("a"), F.lit(0).alias("n")),
            step,
            lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), F.size(sentences).alias("b")))),
        )
        return F.filter(F.transform(ranges, lambda r: trim_blank(F.array_join(F.slice(sentences, r["a"], r["b"] - r["a"] + 1), ""))), lambda p: p != "")

    cut = let(F.split(text, "(?<=[。！？.!?\\n])", -1), lambda s: F.struct(s.alias("s"), F.transform(s, token_estimate).alias("c")))
    return F.when(token_estimate(text) <= size, F.array(text)).otherwise(let(cut, pack))


def _pack(items: Column, cost: Column, size: int, start: Column) -> Column:
    """Greedy ranges (a, b) of array positions; a range never exceeds ``size`` unless it is one item. ``cost``: array of costs."""

    def step(s: Column, i: Column) -> Column:
        c = F.element_at(cost, i)
        over = (i > s["a"]) & (s["n"] + c > size)
        cut = F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), (i - 1).alias("b"))))
        return F.when(over, F.struct(cut.alias("out"), i.alias("a"), (start + c).alias("n"))).otherwise(F.struct(s["out"].alias("out"), s["a"].alias("a"), (s["n"] + c).alias("n")))

    return F.aggregate(
        F.sequence(F.lit(1), F.size(items)),
        F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(1).alias("a"), start.alias("n")),
        step,
        lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), F.size(items).alias("b")))),
    )


def split_code(text: Column, policy: ChunkPolicy) -> Column:
    """Code whole if it is small enough, else cut before definitions and packed."""
    lines = split_lines(text)
    groups = F.aggregate(
        lines,
        F.array().cast("array<array<string>>"),
        lambda g, ln: F.when(
            (F.size(g) == 0) | ln.rlike(_DEFINITION), F.concat(g, F.array(F.array(ln)))
        ).otherwise(F.concat(F.slice(g, 1, F.size(g) - 1), F.array(F.concat(F.element_at(g, -1), F.array(ln))))),
    )
    joined = F.transform(groups, lambda g: F.array_join(g, "\n"))
    pieces = let(joined, lambda j: let(F.transform(j, token_estimate), lambda c: F.transform(_pack(j, c, policy.code_size, F.lit(0)), lambda r: F.array_join(F.slice(j, r["a"], r["b"] - r["a"] + 1), "\n"))))
    return F.when((token_estimate(text) <= policy.hard_max) | (F.size(lines) == 0), F.array(text)).otherwise(pieces)


def split_table(text: Column, policy: ChunkPolicy) -> Column:
    """A table whole if it is small enough, else its rows packed with the header (and separator) repeated."""

    def cut(rows: Column) -> Column:
        ruled = F.coalesce(F.try_element_at(rows, F.lit(2)).rlike("(?U)^\\s*\\|[\\s\\-:|]+\\|\\s*$"), F.lit(False))
        parts = F.when(ruled, F.struct(F.slice(rows, 1, 2).alias("h"), F.slice(rows, 3, 1 << 30).alias("d"))).otherwise(F.struct(F.slice(rows, 1, 1).alias("h"), F.slice(rows, 2, 1 << 30).alias("d")))
        costed = let(parts, lambda p: F.struct(p["h"].alias("h"), p["d"].alias("d"), F.transform(p["d"], token_estimate).alias("c"), token_estimate(F.array_join(p["h"], "")).alias("n")))

        def pack(p: Column) -> Column:
            pieces = F.transform(_pack(p["d"], p["c"], policy.table_size, p["n"]), lambda r: F.array_join(F.concat(p["h"], F.slice(p["d"], r["a"], r["b"] - r["a"] + 1)), "\n"))
            return F.when(F.size(p["d"]) > 0, pieces).otherwise(F.array().cast(_NONE))

        return F.when(F.size(rows) < 2, F.array(text)).otherwise(let(costed, pack))

    rows = F.filter(split_lines(text), lambda r: trim_blank(r) != "")
    return F.when(token_estimate(text) <= policy.table_size, F.array(text)).otherwise(let(rows, cut))


def chunk_blocks(blocks: DataFrame, policy: ChunkPolicy = ChunkPolicy(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """Chunks of blocks: keys, chunk_index, content, heading_path, hash, token count and the block's place."""
    text = F.col("text")
    pieces = (
        F.when(F.col("type") == "code", split_code(text, policy))
        .when(F.col("type") == "table", split_table(text, policy))
        .when(F.col("type") == "image", F.array(text))
        .otherwise(pack_sentences(text, policy.text_size, policy.text_overlap))
    )
    placed = with_heading_path(blocks, keys).filter("type <> 'heading'")
    kept = placed.select("*", F.posexplode(pieces).alias("piece_ord", "piece")).withColumn("token_count", token_estimate("piece"))
    kept = kept.filter((F.col("type") != "text") | (F.col("token_count") >= policy.min_chunk))
    order = Window.partitionBy(*keys).orderBy("block_ord", "piece_ord")
    body = F.when(F.col("heading_path") != "", F.concat(F.lit("["), F.col("heading_path"), F.lit("]\n"), F.col("piece"))).otherwise(F.col("piece"))
    return kept.select(
        *keys, (F.row_number().over(order) - 1).cast("int").alias("chunk_index"), body.alias("content"), F.col("type").alias("block_type"), "heading_path",
        "start_line", "end_line", "page", "bbox", F.col("confidence").alias("layout_confidence"), F.sha1("piece").alias("content_hash"), "token_count",
    )


def chunk_documents(docs: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:  # noqa: B008
    """(chunk_id, doc_id, chunk_index, content, ...) of (doc_id, text) documents; the id is ``doc_id::index``."""
    chunks = chunk_blocks(parse_blocks(docs), policy)
    return chunks.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), *chunks.columns)


PARENT_POLICY = ChunkPolicy(text_size=900, text_overlap=0, min_chunk=20)
CHILD_POLICY = ChunkPolicy(text_size=200, text_overlap=40, min_chunk=10)


def parent_child_chunks(docs: DataFrame, parent: ChunkPolicy = PARENT_POLICY, child: ChunkPolicy = CHILD_POLICY) -> tuple[DataFrame, DataFrame]:
    """(parents, children): each parent's content, heading prefix included, is split again; only children are indexed."""
    parents = chunk_documents(docs, parent).withColumn("parent_id", F.lit(None).cast("string")).withColumn("is_parent", F.lit(True))
    inner = parents.select(
        "doc_id", F.col("chunk_id").alias("parent_id"), F.lit(0).alias("block_ord"), F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(0).alias("level"),
        F.lit("").alias("lang"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(0).alias("page"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(1.0).alias("confidence"),
    )
    children = chunk_blocks(inner, child, ("doc_id", "parent_id"))
    ids = F.concat(F.col("parent_id"), F.lit("::c"), F.col("chunk_index").cast("string"))
    return parents, children.select(ids.alias("chunk_id"), *children.columns, F.lit(False).alias("is_parent"))

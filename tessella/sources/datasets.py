"""JSON Lines data sets with their checks, and nested exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import trim_blank

LABELLED = "query string, relevant_sources array<string>, relevant_doc_ids array<string>, relevant_chunk_ids array<string>"
CASE = (
    "case_id string, category string, description string, documents array<struct<source:string,content:string>>, query string, relevant_sources array<string>, "
    "expected_answer_terms array<string>, forbidden_answer_terms array<string>, top_k int"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of lines that are neither blank nor comments. One file is read whole, as data sets are small."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r\\n|\\n|\\r")).alias("i", "line"))
    return text.select((F.col("i") + 1).alias("line_no"), trim_blank("line").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _fail(bad: DataFrame, what: str) -> None:
    first = bad.orderBy("line_no").limit(1).collect()
    if first:
        raise ValueError(f"line {first[0]['line_no']}: {what}")


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_*): labelled queries; a malformed line is an error that names it."""
    lines = _lines(spark, path)
    if not lines.limit(1).count():
        raise ValueError("the data set is empty")
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    _fail(parsed.filter(F.col("v").isNull()), "not valid JSON")
    _fail(parsed.filter(~F.schema_of_variant("v").startswith("OBJECT")), "not a JSON object")
    for name in ("relevant_sources", "relevant_doc_ids", "relevant_chunk_ids"):
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        _fail(parsed.filter(kind.isNotNull() & ~kind.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")), f"{name} must be a list of strings")
    typed = parsed.select("line_no", F.from_json("line", LABELLED).alias("r")).select("line_no", "r.*").withColumn("query", trim_blank("query"))
    _fail(typed.filter("coalesce(query, '') = ''"), "a query is missing")
    empty = F.array().cast("array<string>")
    return typed.select(F.col("line_no").cast("string").alias("query_id"), "query", *[F.coalesce(c, empty).alias(c) for c in ("relevant_sources", "relevant_doc_ids", "relevant_chunk_ids")])


def check_cases(cases: DataFrame) -> None:
    """Every rule that an evaluation case must keep, as one aggregation over the (small) set."""
    word = "[0-9a-z]+"
    slug = f"^{word}(-{word})*$"
    blank = lambda c: F.coalesce(trim_blank(c), F.lit("")) == ""
    sources = F.transform("documents", lambda d: d["source"])
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    low = lambda c: F.transform(c, F.lower)
    unsafe = F.exists(sources, lambda s: s.isNull() | (F.trim(s) == "") | s.startswith("/") | s.startswith("~") | s.rlike("(^|[/\\\\])\\.\\.([/\\\\]|$)") | F.contains(s, F.lit("\\")))
    rules = {
        "case_id, query and documents are required": blank("case_id") | blank("query") | (F.coalesce(F.size("documents"), F.lit(0)) < 1),
        "case_id and category must be lower-case slugs": ~F.col("case_id").rlike(slug) | ~F.col("category").rlike(slug),
        "a source must be a relative path inside the case": unsafe,
        "a document has no content": F.exists("documents", lambda d: d["content"].isNull() | (trim_blank(d["content"]) == "")),
        "relevant_sources and expected_answer_terms are required": (F.size("relevant_sources") < 1) | (F.size("expected_answer_terms") < 1),
        "sources repeat": repeated(sources),
        "a list repeats a value": repeated(F.col("relevant_sources")) | repeated(F.col("expected_answer_terms")) | repeated(F.col("forbidden_answer_terms")),
        "a term is both expected and forbidden": F.size(F.array_intersect(low("expected_answer_terms"), low("forbidden_answer_terms"))) > 0,
        "relevant_sources name unknown documents": F.size(F.array_except("relevant_sources", sources)) > 0,
        "top_k must be positive": F.col("top_k") <= 0,
    }
    for rule, broken in rules.items():
        found = cases.filter(F.coalesce(broken, F.lit(True))).select("case_id").limit(1).collect()
        if found:
            raise ValueError(f"evaluation case {found[0][0]!r}: {rule}")
    again = cases.groupBy("case_id").count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"evaluation case {again[0][0]!r} appears more than once")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Checked evaluation cases."""
    lines = _lines(spark, path)
    if not lines.limit(1).count():
        raise ValueError("the case file is empty")
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    _fail(parsed.filter(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))), "not a JSON object")
    cases = parsed.select(F.from_json("line", CASE).alias("c")).select("c.*")
    empty = F.array().cast("array<string>")
    cases = cases.withColumns({
        "case_id": trim_blank(F.coalesce("case_id", F.lit(""))), "category": trim_blank(F.coalesce("category", F.lit("general"))), "query": trim_blank(F.coalesce("query", F.lit(""))),
        "description": trim_blank(F.coalesce("description", F.lit(""))), "top_k": F.coalesce("top_k", F.lit(3)),
        **{c: F.coalesce(c, empty) for c in ("relevant_sources", "expected_answer_terms", "forbidden_answer_terms")},
    })
    check_cases(cases)
    return cases


def export_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One JSON text per document: its raw length, chunk count and chunks in order (write with ``.write.text``)."""
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "block_type", "heading_path", "token_count", "content"))).alias("chunks"))
    whole = documents.select("doc_id", F.length("text").alias("raw_length")).join(rows, "doc_id", "left")
    return whole.select(F.to_json(F.struct("doc_id", "raw_length", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count"), "chunks")).alias("value"))


def export_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: document_count, total_chunk_count, raw_characters."""
    n = chunks.agg(F.count(F.lit(1)).alias("total_chunk_count"))
    return documents.agg(F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("raw_characters")).crossJoin(F.broadcast(n))


def write_report(report: dict, path: str) -> None:
    with open(path, mode="w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, default=str)

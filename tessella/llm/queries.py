"""The thin queries of the corpus operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, audio, langid, mixing, packing, secrets, sharding, simhash, tokens, toxicity
from tessella.session import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary: TESSELLA_VOCABULARY, else the installed files."""
    chosen = os.environ.get("TESSELLA_VOCABULARY")
    if chosen:
        return chosen
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest_texts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train_markov(secrets.labelled_samples(documents))
    found = secrets.scan_secrets(documents, model).select("doc_id", "base_spans", "spans")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.render_spans(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.render_spans(F.col("spans")).alias("spans"),
    )


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify_languages(documents, langid.train_languages(documents))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mpeg_audio, op2_toxicity, op3_packing, op4_simhash, op5_feistel_shards, op6_token_counts, op7_secrets, op8_weighted_mix,
        op9_hilbert_neighbours, op10_language_id, pipeline,
    )
}

_MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), named AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS occurrence FROM rows
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM named GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rank FROM per
), capped AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
    sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM ranked
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM capped
), sources AS (
  SELECT source, source_size, rank, budget, least(cap::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target FROM levels
), queued AS (
  SELECT n.*, epoch, md5(concat_ws(':', '0', epoch, coalesce(doc_id::VARCHAR, ''), size, occurrence)) AS h, source_size, rank, budget, target
  FROM named n JOIN sources s ON n.source IS NOT DISTINCT FROM s.source CROSS JOIN (VALUES (0), (1)) e(epoch)
), timed AS (
  SELECT *, CASE WHEN target > 0 THEN (sum(size) OVER (PARTITION BY rank ORDER BY epoch, h, doc_id, size ROWS UNBOUNDED PRECEDING))::DOUBLE / target ELSE 0 END AS finish FROM queued
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, h, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS take FROM timed
)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, (size * count(*) FILTER (WHERE take))::BIGINT AS taken
FROM cut GROUP BY doc_id, source, size, occurrence
"""

ORACLE_SQL = {"op8_weighted_mix": _MIX_SQL}

"""Incremental sync: manifest diff, chunk reuse and snapshot replacement, as joins on ``doc_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "doc_id string, source_hash string, version int, updated_at bigint"


def diff_manifest(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, action, source_hash, version, previous_version): ADD, UPD, SKIP or DEL of each document of either side."""
    new = sources.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("new_hash"))
    old = manifest.select("doc_id", F.col("source_hash").alias("old_hash"), F.col("version").alias("previous_version"))
    action = (
        F.when(F.col("old_hash").isNull(), "ADD").when(F.col("new_hash").isNull(), "DEL").when(F.col("old_hash") == F.col("new_hash"), "SKIP").otherwise("UPD")
    )
    both = new.join(old, "doc_id", "full_outer").withColumn("action", action)
    version = F.when(F.col("action") == "ADD", 1).when(F.col("action") == "UPD", F.col("previous_version") + 1).otherwise(F.col("previous_version"))
    return both.select("doc_id", "action", F.coalesce("new_hash", "old_hash").alias("source_hash"), version.cast("int").alias("version"), "previous_version")


def next_manifest(diff: DataFrame, manifest: DataFrame, now: int) -> DataFrame:
    """The manifest after a sync at ``now`` (epoch seconds); unchanged documents keep their time."""
    kept = diff.filter("action <> 'DEL'").join(manifest.select("doc_id", F.col("updated_at").alias("was")), "doc_id", "left")
    return kept.select("doc_id", "source_hash", "version", F.when(F.col("action") == "SKIP", F.col("was")).otherwise(F.lit(now)).cast("bigint").alias("updated_at"))


def reuse_flags(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """Add ``reused``: whether the same document already held a chunk of the same content hash."""
    old = old_chunks.select("doc_id", "content_hash").distinct().withColumn("reused", F.lit(True))
    return new_chunks.join(old, ["doc_id", "content_hash"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def reuse_vectors(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """Give chunks of known content their old vector; a null vector is to be embedded."""
    old = old_chunks.filter(F.col("vector").isNotNull()).groupBy("doc_id", "content_hash").agg(F.first("vector").alias("vector"))
    return new_chunks.drop("vector").join(old, ["doc_id", "content_hash"], "left")


def delete_by_doc(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def count_by_doc(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, chunks) that a deletion would remove."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


def replace_documents(old_chunks: DataFrame, new_chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """The next snapshot: what no change touches, and the new chunks. Readers never see a gap between the two."""
    touched = diff.filter("action in ('UPD', 'DEL')").select("doc_id")
    return delete_by_doc(old_chunks, touched).unionByName(new_chunks, allowMissingColumns=True)


def upsert(chunks: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def sync_report(diff: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """One row: added, updated, deleted (chunks), skipped, reembedded_chunks, reused_chunks, details."""
    gone = count_by_doc(old_chunks, diff.filter("action in ('UPD', 'DEL')")).withColumnRenamed("chunks", "gone")
    updated = diff.filter("action = 'UPD'").select("doc_id")
    flagged = reuse_flags(new_chunks, old_chunks.join(updated, "doc_id", "left_semi"))
    made = flagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("made"), F.sum(F.col("reused").cast("int")).alias("reused"))
    per = diff.join(gone, "doc_id", "left").join(made, "doc_id", "left").fillna(0, ["gone", "made", "reused"])
    line = (
        F.when(F.col("action") == "ADD", F.format_string("[ADD] %s -> %d chunks", "doc_id", "made"))
        .when(F.col("action") == "UPD", F.format_string("[UPD] %s v%d: del %d -> add %d", "doc_id", "version", "gone", "made"))
        .when(F.col("action") == "DEL", F.format_string("[DEL] %s -> removed %d chunks", "doc_id", "gone"))
    )
    many = lambda a: F.coalesce(F.sum((F.col("action") == a).cast("bigint")), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(
        many("ADD").alias("added"), many("UPD").alias("updated"), total("gone").alias("deleted"), many("SKIP").alias("skipped"),
        total(F.col("made") - F.col("reused")).alias("reembedded_chunks"), total("reused").alias("reused_chunks"), F.array_sort(F.collect_list(line)).alias("details"),
    )

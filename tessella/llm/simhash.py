"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint takes the majority of the XXH64 hashes of a text's word shingles in each bit. Two fingerprints
within 2r differing bits have a common point within r bits of both. So every distinct fingerprint emits all variants
within r = half the radius, a shuffle brings equal variants together, and those that meet are linked after the
distance is verified. What meets at a variant lies in a ball around it, so its members are kept as the set of their
flips: a bitmap that pre-aggregates before the shuffle and never holds more than the ball (65 for r = 1), however
many copies a text has. Links to the smallest member of each ball keep all connections; components follow by
hooking to the smallest neighbouring label and pointer jumping, each round written to the shared folder.

Defined results: null is the empty text; a text without words has fingerprint 0, linked like any other; a text with
fewer words than a shingle is one shingle; repeated shingles count again; repeated rows share their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_or_empty
from tessella.session import discard, durable, ship_package

SEED = 42


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``words``-word shingle of the ASCII-lower-cased text."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[: -words + 1 or None].tolist(), ends[words - 1 :].tolist(), strict=True)),
        np.uint64,
        len(parts) - words + 1,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a very long text unpacks in slices
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""
    ship_package(df.sparkSession)
    source = df.select(key, text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(got.view(np.int64))], [key, "fp"])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp bigint")


def _masks(radius: int) -> list[int]:
    """Signed XOR masks of all points within ``radius`` (0 or 1) bits."""
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)] if radius else []
    return [0, *flips]


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) with a > b: links within ``radius`` (at most 2) bits that join every pair within it, for distinct ``fps``(fp)."""
    if not 0 <= radius <= 2:
        raise ValueError("balls are hashed for a radius of at most 2 bits")
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(half)])
    # Distinct fingerprints are few bytes before each becomes a ball; a partitioning of their own keeps them from being coalesced.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.hash("fp"))
    emitted = spread.select("fp", F.posexplode(masks).alias("at", "mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"),
        F.when(F.col("at") > 0, F.col("mask")).otherwise(F.lit(0).cast("bigint")).alias("flip"),
        (F.col("at") == 0).cast("int").alias("own"),
    )
    met = emitted.groupBy("variant").agg(F.bit_or("flip").alias("flips"), F.max("own").alias("own"))
    met = met.filter(F.bit_count("flips") + F.col("own") > 1)
    members = met.select(
        F.filter(
            F.transform(masks, lambda m, i: F.when(F.when(i == 0, F.col("own") == 1).otherwise(F.col("flips").bitwiseAND(m) != 0), F.col("variant").bitwiseXOR(m))),
            lambda x: x.isNotNull(),
        ).alias("m")
    )
    if radius % 2 == 0:  # all members of a ball are within the radius: links to the smallest keep them joined
        pairs = members.select(F.explode("m").alias("a"), F.array_min("m").alias("b"))
    else:  # they may be one bit too far apart: all pairs of the (at most 65) members are candidates
        pairs = members.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b"))
    pairs = pairs.filter("a > b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links``(a, b): the label is the smallest node of its component."""
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("hook"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
        jumped = hooked.join(up, F.col("hook") == F.col("up")).select("node", "old", F.least("hook", "above").alias("label"))
        new = durable(jumped)
        moved = new.filter("old <> label").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(edges)
            return labels


def near_duplicates(df: DataFrame, radius: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): the component is the smallest key reachable over links, the row's own included."""
    rows = durable(fingerprints(df, words, key, text))
    return assign_components(rows, radius, key)


def assign_components(rows: DataFrame, radius: int = 2, key: str = "doc_id") -> DataFrame:
    """As ``near_duplicates``, from stored (key, fp) rows; other columns stay."""
    distinct = rows.groupBy("fp").agg(F.min(key).alias("__least"))
    distinct = durable(distinct)
    labels = components(ball_links(distinct.select("fp"), radius))
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "__least", F.coalesce("label", "fp").alias("__label"))
    labelled = durable(labelled)
    discard(distinct, labels)
    least = labelled.groupBy("__label").agg(F.min("__least").alias("component"))
    return rows.join(labelled.join(least, "__label").select("fp", "component"), "fp")

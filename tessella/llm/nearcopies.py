"""Near copies by the true Jaccard similarity of word-shingle sets.

Candidates come from SimHash: sets whose fingerprints lie within 2 bits meet in ``simhash``'s balls. At similarity 0.8
most pairs lie further apart than any ball that can be emitted, so the rest comes from MinHash: 60 bands of 6 minima
each, in which texts that agree in at least 3 bands are candidates. Every candidate of either kind is verified on the
whole sets, so no link is false, and what the balls join is not compared again in a band. A pair at similarity 0.8
exactly agrees in a band with probability 0.8^6 and is missed by the bands with probability 3e-6, a more similar one
with less.

A band that many texts share is no list in one task, and its pairs are not all compared: each member is compared with
the smallest one first, the links so found make components, and only members of different components are compared
after that. So the components are those of all candidate pairs, while a crowd of copies of copies costs one
comparison for each of them and band.

Defined results: texts with equal sets are one node (the XXH64 of the sorted set), so copies cost nothing; null and
texts without words share the empty set; a text with fewer words than a shingle is one shingle; repeats count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_or_empty
from tessella.llm.simhash import SEED, ball_links, components, fingerprint, shingle_hashes
from tessella.session import discard, durable, ship_package

BANDS, ROWS, AGREE = 60, 6, 3
_RNG = np.random.default_rng(SEED)
#: Odd multipliers permute the 64-bit numbers: one for each minimum, and one for each row of a band to mix its key.
_PERMUTE = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; none for the empty set, which no other set resembles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(len(_PERMUTE), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):  # slices that stay in the processor's cache
        np.minimum(least, (shingles[at : at + 256, None] * _PERMUTE).min(axis=0), out=least)
    low = least.reshape(BANDS, ROWS)
    return ((low ^ (low >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_rows(df: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, n, fp, bands): the set's node, its size, its SimHash fingerprint and its band keys."""
    ship_package(df.sparkSession)
    source = df.select(key, text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nodes, sizes, prints, bands = [], [], [], []
                for t in part.column(1):
                    shingles = shingle_set(t.as_py(), words)
                    nodes.append(node_of(shingles))
                    sizes.append(len(shingles))
                    prints.append(fingerprint(shingles))
                    bands.append(band_keys(shingles))
                fps = pa.array(np.array(prints, np.uint64).view(np.int64))
                yield pa.record_batch([part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), fps, pa.array(bands, pa.list_(pa.int64()))], [key, "node", "n", "fp", "bands"])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, node bigint, n int, fp bigint, bands array<bigint>")


def shingle_rows(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(node, shingles): the whole set of each row of ``df``."""
    source = df.select(text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), words) for t in batch.column(0).slice(at, 256)]
                yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return source.mapInArrow(run, "node bigint, shingles array<bigint>")


def _fits(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) with a > b: of ``nodes``(node, fp), the smallest nodes of fingerprints that a ball links, and those of one fingerprint with its smallest."""
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    met = ball_links(prints.select("fp"))
    for side in "ab":
        met = met.join(prints.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head")), side)
    equal = nodes.join(prints, "fp").filter(F.col("node") > F.col("head")).select(F.col("node").alias("a_head"), F.col("head").alias("b_head"))
    pairs = met.select("a_head", "b_head").unionByName(equal)
    return pairs.select(F.greatest("a_head", "b_head").alias("a"), F.least("a_head", "b_head").alias("b")).distinct()


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, node, n, first, first_n): the ``nodes``(node, n, bands) of each band that more than one has, and its smallest node."""
    members = nodes.select(F.explode("bands").alias("band"), "node", "n")
    first = members.groupBy("band").agg(F.min(F.struct("node", "n")).alias("x"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return members.join(first.select("band", F.col("x.node").alias("first"), F.col("x.n").alias("first_n")), "band")


def cross_pairs(shared: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b) with a > b: nodes of different components that agree in enough bands and whose sizes allow the similarity."""
    linked = labels.select(F.col("node").alias("linked"), "label")
    held = shared.join(linked, F.col("node") == F.col("linked"), "left").select("band", "node", "n", F.coalesce("label", "node").alias("part"))
    several = held.groupBy("band").agg((F.min("part") != F.max("part")).alias("open")).filter("open")
    apart = durable(held.join(several.select("band"), "band", "left_semi"))
    x, y = apart.alias("x"), apart.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & _fits(F.col("x.n"), F.col("y.n"), similarity))
    pairs = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    return pairs.filter(F.col("bands") >= AGREE).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs``(a, b) whose whole ``sets``(node, shingles) are that similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("shared"), (F.size("s") + F.size("t")).alias("total"))
    return shared.filter(F.col("shared") / (F.col("total") - F.col("shared")) >= F.lit(similarity)).select("a", "b")


def assign_near_copies(rows: DataFrame, df: DataFrame, similarity: float = 0.8, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): the component is the smallest key reachable over pairs of at least ``similarity``.

    ``rows`` are the stored ``band_rows`` of ``df``; the sets of the candidates are read again from its texts. At
    similarities under 0.8 the bands miss more.
    """
    nodes = durable(rows.groupBy("node").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    balls = durable(ball_pairs(nodes))
    shared = durable(shared_bands(nodes))
    met = shared.select("node").unionByName(balls.select(F.explode(F.array("a", "b")).alias("node")))
    chosen = nodes.join(met.distinct(), "node", "left_semi").select("least")
    texts = df.join(chosen, df[key].eqNullSafe(F.col("least")), "left_semi")
    sets = durable(shingle_rows(texts, words, text).dropDuplicates(["node"]))
    stars = shared.filter((F.col("node") > F.col("first")) & _fits(F.col("n"), F.col("first_n"), similarity)).select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = durable(similar(balls.unionByName(stars).distinct(), sets, similarity))
    labels = components(links)
    more = durable(similar(cross_pairs(shared, labels, similarity), sets, similarity))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    labelled = nodes.join(labels.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    labelled = durable(labelled)
    discard(nodes, balls, shared, sets, links, more, labels)
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    return rows.select(key, "node").join(labelled.join(least, "label").select("node", "component"), "node").select(key, "component")

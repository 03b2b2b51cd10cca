"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves rotates the unit vectors by its own random orthogonal projection to a few dimensions, shifts
and quantises them on quantiles of a bounded sample, and orders all vectors by Hilbert key. The order of every curve is
cut into blocks of a fixed row count; a query visits its own block and the neighbouring ones on every curve. What all
visits find is merged, deduplicated and reranked by exact cosine in double precision. Positions are exact and ties of
keys go by id and vector, so reruns agree. There is no other path: every table, of any size, is searched this way.

How far windows reach is measured, not fixed: a hash-ordered sample of the queries is compared with the whole table,
and the reach is the least, from ``reach`` on, at which their windows hold the stated share of the true neighbours.
On vectors without structure that is a fixed part of every curve, and the work grows with queries x rows. Equal
vectors are one entry with its smallest ids, so a group of copies that is a third of the table fills neither a block
nor a window, and their ties are exact.

Defined results: a vector that is null, zero, or holds a null or non-finite component takes no part; vectors of each
length are searched among themselves; rows that repeat an id and its vector are one; a query that has fewer than ``k``
candidates gets all that were found; an empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.session import durable, ship_package


@dataclass(frozen=True)
class CurveIndex:
    """Projections (curves x dimension x axes) and cell borders (curves x axes x 2^bits - 1) of all curves."""

    projections: np.ndarray
    borders: np.ndarray
    bits: int


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of integer cells (rows x axes), by Skilling's transposition."""
    x = [c.astype(np.uint64).copy() for c in cells.T]
    n, one = len(x), np.uint64(1)
    q = np.uint64(1) << np.uint64(bits - 1)
    top = q
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > one:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - one), t)
        q >>= one
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ t) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: no cosine changes, and no square over- or underflows."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    return np.ldexp(vectors, -np.frexp(largest)[1])


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_curves(sample: np.ndarray, curves: int = 8, axes: int = 6, bits: int = 8, seed: int = 0) -> CurveIndex:
    """Rotations, and cells on the sample's quantiles, shifted by a random part of a cell for each curve and axis."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    axes = min(axes, dim)
    unit = unit_rows(sample)
    projections, borders = [], []
    for _ in range(curves):
        p = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes]
        shift = rng.random(axes)
        y = unit @ p
        at = (np.arange(1, 2**bits)[None, :] - shift[:, None]) / 2**bits
        borders.append(np.stack([np.quantile(y[:, j], np.clip(at[j], 0, 1)) for j in range(axes)]))
        projections.append(p)
    return CurveIndex(np.stack(projections), np.stack(borders), bits)


def curve_keys(index: CurveIndex, vectors: np.ndarray) -> np.ndarray:
    """Keys of each vector on each curve (rows x curves)."""
    unit = unit_rows(vectors)
    out = np.empty((len(vectors), len(index.projections)), np.int64)
    for c, (p, borders) in enumerate(zip(index.projections, index.borders, strict=True)):
        y = unit @ p
        cells = np.stack([np.searchsorted(borders[j], y[:, j], "right") for j in range(y.shape[1])], axis=1)
        out[:, c] = hilbert_keys(cells, index.bits)
    return out


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of row-wise pairs, each by the same order of additions, so equal vectors score equal."""
    queries, vectors = scaled(queries), scaled(vectors)
    dot = (queries * vectors).sum(axis=1)
    return dot / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1)))


def usable(vector: Column) -> Column:
    """Whether a vector can be searched: neither null nor zero, no null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def _floats(df: DataFrame, vector: str) -> Column:
    """The vectors as they are if single precision, which no cast changes and which take half the room; else as doubles."""
    return F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def best_in_block(pairs_q: np.ndarray, vectors: np.ndarray, keep: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row the entries among its ``keep`` largest cosines, those within rounding of the last included."""
    unit, asked = unit_rows(vectors), unit_rows(pairs_q)
    for at in range(0, len(asked), 256):  # blocks of queries keep the score matrix small
        part = asked[at : at + 256]
        sims = part @ unit.T
        n = min(keep, sims.shape[1])
        floor = np.partition(sims, sims.shape[1] - n, axis=1)[:, sims.shape[1] - n]
        for i in range(len(part)):
            yield at + i, np.flatnonzero(sims[i] >= floor[i] - 1e-9)


def scan_best(entries: DataFrame, askers: list, k: int, dim: int, kind: str) -> DataFrame:
    """(asker, id, score, entry): of each partition of ``entries``(v, ids, entry) the ``k`` + 1 best for each (entry, v) of ``askers``."""
    numbers, queries = [a["entry"] for a in askers], np.array([a["v"] for a in askers], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in numbers]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ids, entry = _matrix(batch.column(0), dim), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, near in best_in_block(queries, vectors, k + 1):
                scores = cosines(np.broadcast_to(queries[i], (len(near), dim)), vectors[near])
                best[i] = sorted(best[i] + [(-s, x, entry[j]) for s, j in zip(scores.tolist(), near, strict=True) for x in ids[j]])[: k + 1]
        for i, found in enumerate(best):
            if found:
                yield pa.RecordBatch.from_pylist([{"asker": numbers[i], "id": x, "score": -s, "entry": e} for s, x, e in found], schema=out)

    schema = f"asker bigint, id {kind}, score double, entry bigint"
    out = to_arrow_schema(StructType.fromDDL(schema))
    return entries.select("v", "ids", "entry").mapInArrow(run, schema)


def placed_on_curves(entries: DataFrame, index: CurveIndex, n: int, dim: int, kind: str, block_rows: int) -> DataFrame:
    """(entry, block): the block of each of the ``n`` ``entries`` on each curve; blocks of a curve follow those of the one before."""
    curves = len(index.projections)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = curve_keys(index, _matrix(batch.column(0), dim)) if batch.num_rows else np.empty((0, curves), np.int64)
            for c in range(curves):
                yield pa.record_batch([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys[:, c]), *batch.columns[1:]], ["curve", "key", *batch.schema.names[1:]])

    order = ["curve", "key", "id", "hash"]
    rows = entries.select("v", "id", F.xxhash64("v").alias("hash"), "entry").mapInArrow(keyed, f"curve int, key bigint, id {kind}, hash bigint, entry bigint")
    spread = rows.repartitionByRange(max(1, -(-n * curves // 65536)), *order).sortWithinPartitions(*order)
    # The number is that of the partition, shifted by 33 bits, and the place in it: counts of the partitions before make it a position.
    numbered = durable(spread.select("entry", F.monotonically_increasing_id().alias("at")))
    counts = {r["p"]: r["n"] for r in numbered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    first = entries.sparkSession.createDataFrame(starts, "p bigint, start bigint")
    position = F.col("start") + F.col("at") - F.shiftleft("p", 33)
    curve, rank = F.floor(position / F.lit(n)), position % F.lit(n)
    block = curve * F.lit(-(-n // block_rows)) + F.floor(rank / F.lit(block_rows))
    return durable(numbered.join(F.broadcast(first), F.shiftright("at", 33) == F.col("p")).select("entry", block.cast("bigint").alias("block")))


def needed_reach(placed: DataFrame, entries: DataFrame, sampled: list, k: int, dim: int, kind: str, share: float) -> int:
    """The least reach at which the windows of the ``sampled`` queries hold ``share`` of their true neighbours."""
    if not sampled:
        return 0
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    truth = scan_best(entries, sampled, k, dim, kind).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    pairs = [(r["asker"], r["entry"]) for r in truth.select("asker", "entry").collect() if r["asker"] != r["entry"]]
    if not pairs:
        return 0
    held = placed.sparkSession.createDataFrame([(e,) for e in {e for p in pairs for e in p}], "entry bigint")
    blocks: dict[int, list[int]] = {}
    for r in placed.join(F.broadcast(held), "entry", "left_semi").collect():
        blocks.setdefault(r["entry"], []).append(r["block"])
    apart = sorted(min(abs(x - y) for x, y in zip(sorted(blocks[a]), sorted(blocks[b]), strict=True)) for a, b in pairs)
    return apart[max(1, min(len(apart), math.ceil(share * len(apart)))) - 1]


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    curves: int = 8,
    axes: int = 6,
    bits: int = 8,
    block_rows: int = 4096,
    reach: int = 1,
    sample_rows: int = 4096,
    seed: int = 0,
    key: str = "vec_id",
    vector: str = "embedding",
    share: float = 0.95,
    probes: int = 256,
    group: int = 8192,
) -> DataFrame:
    """(query_id, rank, <key>, score): the ``k`` nearest found for each row for which ``is_query`` holds, itself apart.

    ``is_query`` is a condition on the key column. The curves' quantiles come from at most ``sample_rows`` vectors.
    ``reach`` is the least reach; ``probes`` queries decide how much more holds ``share`` of their true neighbours.
    A block that more than ``group`` queries can visit takes them in parts.
    """
    spark = df.sparkSession
    ship_package(spark)
    named = df.select(F.col(key).alias("id"), _floats(df, vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = named.filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).collect()
    kind = df.schema[key].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    if len(sizes) > 1:  # each length has an index of its own
        apart = [nearest(df.filter(F.size(vector) == r["d"]), is_query, k, curves, axes, bits, block_rows, reach, sample_rows, seed, key, vector, share, probes, group) for r in sizes]
        return reduce(DataFrame.unionByName, apart)
    dim = sizes[0]["d"]
    # Equal vectors become one entry with its k + 1 smallest ids; the rank is limited before the shuffle, too.
    rows = good.filter(F.size("v") == dim).select("id", "v", "q").distinct()
    low = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    asked = rows.filter("q").select("v").distinct().withColumn("asked", F.lit(True))
    entries = low.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asked, "v", "left")
    entries = durable(entries.select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), F.col("ids")[0].alias("id"), F.monotonically_increasing_id().alias("entry")))
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()
    index = fit_curves(np.array([r["v"] for r in sample]), curves, axes, bits, seed)
    n = entries.count()

    placed = placed_on_curves(entries, index, n, dim, kind, block_rows)
    sampled = entries.filter("asked").orderBy(F.xxhash64("id"), "id").limit(probes).select("entry", "v").collect()
    reach = max(reach, needed_reach(placed, entries, sampled, k, dim, kind, share))
    per_curve = -(-n // block_rows)
    curve_start = F.floor(F.col("block") / F.lit(per_curve)) * per_curve
    window = F.sequence(F.greatest(F.col("block") - reach, curve_start), F.least(F.col("block") + reach, curve_start + (per_curve - 1)))
    # At most as many queries can visit a block as its window has rows.
    parts = max(1, -(-min(entries.filter("asked").count(), (2 * reach + 1) * block_rows) // group))
    askers = entries.filter("asked").select("entry", F.col("entry").alias("asker"), F.col("v").alias("qv"), F.pmod(F.xxhash64("entry"), F.lit(parts)).cast("int").alias("part"))
    visits = placed.join(askers, "entry").select(F.explode(window).alias("block"), "part", "asker", "qv")
    stored = placed.join(entries.select("entry", "v", "ids"), "entry").select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "v", "ids")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"asker": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            queries, vectors = _matrix(left["qv"], dim), _matrix(right["v"], dim)
            numbers, ids = left["asker"].to_pylist(), right["ids"].to_pylist()
            for i, near in best_in_block(queries, vectors, k + 1):
                scores = cosines(np.broadcast_to(queries[i], (len(near), dim)), vectors[near])
                for s, x in sorted((-s, x) for s, j in zip(scores.tolist(), near, strict=True) for x in ids[j])[: k + 1]:
                    found["asker"].append(numbers[i])
                    found["id"].append(x)
                    found["score"].append(-s)
        return pa.Table.from_pydict(found, schema=out_schema)

    schema = f"asker bigint, id {kind}, score double"
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    found = visits.groupBy("block", "part").cogroup(stored.groupBy("block", "part")).applyInArrow(rerank, schema)
    # A pair found in several blocks has one score; k + 1 of a query vector are enough for every row that holds it.
    merged = found.groupBy("asker", "id").agg(F.max("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    near = best.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("near"))
    askers = entries.filter("asked").select("v", F.col("entry").alias("asker"))
    queries = rows.filter("q").select(F.col("id").alias("query_id"), "v").join(askers, "v").select("query_id", "asker")
    own = queries.join(near, "asker")
    others = own.select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    out = others.select("query_id", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), (-F.col("x.s")).alias("score"))

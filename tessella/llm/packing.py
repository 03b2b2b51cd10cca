"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document longer than a window is first cut into full windows. What is left of it (or all of a short document)
is placed longest first into the tightest open window, which a segment tree indexed by remaining capacity finds.
Lengths are small integers, so the packing is solved for the histogram of lengths: at most ``window`` counts
reach the driver whatever the corpus, and equal lengths move through the tree in one step. Each piece then finds
its window by its rank among pieces of its length; ranks are counted in hash buckets whose number follows the number
of pieces, and equal pieces are ranked as one group, so that neither one length nor one text is a single task.

Defined results: a null text is empty (its document is the end token alone); repeated rows are packed again;
equal rows are interchangeable; an empty table gives no pieces. Only the key and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import equal_groups, expand_groups, group_sizes, number_groups, text_or_empty
from tessella.llm.tokens import balanced, encoder
from tessella.session import ship_package


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have an open window."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = present
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= ``least`` with an open window."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i & 1 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass(frozen=True)
class Slot:
    """Pieces of one length, ranks base.. on: ``each`` of them in every window from ``first`` on, from ``offset`` on."""

    base: int
    each: int
    first: int
    offset: int


def plan_packing(histogram: dict[int, int], window: int) -> tuple[dict[int, list[Slot]], int]:
    """Where pieces of each length go, and how many windows that takes."""
    tree, opened, slots, windows = CapacityTree(window), {}, {}, 0

    def put(capacity: int, first: int, count: int) -> None:
        opened.setdefault(capacity, []).append((first, count))
        tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, base, mine = histogram[length], 0, []
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, -(-left // (window // length))
                windows += count
            else:
                first, count = opened[capacity].pop()
                if not opened[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(count, left // each)
            if full:
                mine.append(Slot(base, each, first, window - capacity))
                put(capacity - each * length, first, full)
                base, left, first, count = base + full * each, left - full * each, first + full, count - full
            if left and count:
                mine.append(Slot(base, left, first, window - capacity))
                put(capacity - left * length, first, 1)
                base, left, first, count = base + left, 0, first + 1, count - 1
            if count:
                put(capacity, first, count)
        slots[length] = mine
    return slots, windows


def cut_documents(df: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise and cut: (key, start, length, ids_crc32, doc_tokens) of each piece."""
    ship_package(df.sparkSession)
    source = df.select(key, text_or_empty(text).alias("__text"))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at, texts, _ in balanced(batch.column(1)):
                rows, take = [], []
                for k, ids in enumerate(enc.ids(texts)):
                    ids += tail
                    n = len(ids) >> 2
                    for s in range(0, n, window):
                        rows.append((s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n))
                        take.append(at + k)
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, pa.int64()) for c in cols)],
                    [key, "start", "length", "ids_crc32", "doc_tokens"],
                )

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack_pieces(pieces: DataFrame, window: int = 2048, key: str = "doc_id") -> DataFrame:
    """Give each piece of ``cut_documents`` its sequence_id and offset."""
    ship_package(pieces.sparkSession)
    columns = [key, "start", "length", "ids_crc32", "doc_tokens"]
    groups = equal_groups(pieces.select(*columns))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("__count").alias("n")).collect()}  # <= window rows
    slots, _ = plan_packing(histogram, window)
    n, most = group_sizes(groups)
    numbered = expand_groups(number_groups(groups, ["length"], n), most)
    ranked = numbered.select(*columns, (F.col("__first") + F.col("__nth")).alias("__rank"))
    where = {n: tuple(np.array([getattr(s, f) for s in mine], np.int64) for f in ("base", "each", "first", "offset")) for n, mine in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch.column(2)), np.asarray(batch.column(5))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                rows = lengths == n
                base, each, first, start = where[int(n)]
                k = np.searchsorted(base, ranks[rows], "right") - 1
                d = ranks[rows] - base[k]
                sequence[rows] = first[k] + d // each[k]
                offset[rows] = start[k] + d % each[k] * n
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents; one row per piece with its place."""
    return pack_pieces(cut_documents(df, vocabulary, window, end_id, key, text), window, key)

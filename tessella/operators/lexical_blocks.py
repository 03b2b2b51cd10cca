"""Lexical scores of blocks of chunks in arrays, where the terms and phrases of all queries fit the memory of a task.

Every text is cut into terms once. What it holds of the queries' terms and phrases is stored as numbers, next to the
statistics of all chunks; scores are then added up block by block, a row for each chunk and a column for each query,
and a block hands on the best hits of each query only. No pair of a query and a chunk is ever shuffled but those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of one array of a block: terms or phrases found in a few chunks, cells of chunks and queries.
BLOCK = 1 << 21
#: Up to this many entries the steps of the trie are one table; beyond it they are searched.
TABLE = 1 << 23

#: What each posting row holds; the rows with ``n`` are statistics (chunks, texts, terms; df in tf) of all chunks of a task.
POSTINGS = "n bigint, texts bigint, dl bigint, ids array<int>, tf array<int>, features array<int>"


@dataclass(frozen=True)
class Trie:
    """Phrases by their characters: all that stand in any of many texts are found at once, a character at a time."""

    codes: np.ndarray
    width: int
    edges: np.ndarray
    child: np.ndarray
    table: np.ndarray | None
    phrase: np.ndarray

    @staticmethod
    def of(phrases: list[str]) -> Trie:
        letters = sorted({c for p in phrases for c in p})
        codes = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        width, steps, ends = len(letters) + 1, {}, [-1]
        for i, p in enumerate(phrases):
            node = 0
            for c in p:
                node = steps.setdefault(node * width + int(codes[ord(c)]), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        order = sorted(steps)
        edges, child, table = np.array(order, np.int64), np.array([steps[k] for k in order], np.int64), None
        if len(ends) * width <= TABLE:
            table = np.full(len(ends) * width, -1, np.int32)
            table[edges] = child
        return Trie(codes, width, edges, child, table, np.array(ends, np.int64))

    def _step(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[keys]
        if not len(self.edges):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        return np.where(self.edges[at] == keys, self.child[at], -1)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of texts, numbers of the phrases in them), sorted by text; a phrase may come more than once."""
        letters = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)
        code = self.codes[np.minimum(letters, len(self.codes) - 1)]
        ends = letters == 0
        owner = np.cumsum(ends) - ends
        at, depth, found = np.flatnonzero(code), 0, []
        node = np.zeros(len(at), np.int64)
        while len(at):
            node = self._step(node * self.width + code[at + depth])  # a text ends with a character that no phrase has
            alive = node >= 0
            at, node, depth = at[alive], node[alive], depth + 1
            full = self.phrase[node] >= 0
            found.append((owner[at[full]], self.phrase[node[full]]))
        which, phrase = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        order = np.argsort(which, kind="stable")
        return which[order], phrase[order]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def pieces(sizes: np.ndarray, most_rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BLOCK`` numbers in all, and of ``most_rows`` at most."""
    group = np.cumsum(sizes, dtype=np.int64) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        for c in range(a, b, most_rows):
            yield c, min(b, c + most_rows)


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(rows: np.ndarray, values: np.ndarray, size: int) -> pa.Array:
    """Values that are sorted by row, as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(size + 1)), pa.int32()), pa.array(values, pa.int32()))


def cutter(terms: pa.Array, trie: Trie, phrases: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (chunk_id, ok, t, r, h, s, ht, st) to batches (chunk_id, ``POSTINGS``).

    Features: phrases in the content's, the heading's and the source's runs, then terms among the heading's and the source's.
    """
    wide = len(terms)

    def encoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        coded = lists.flatten().dictionary_encode()
        return np.repeat(np.arange(len(lists)), _counts(lists)), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def numbers(words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def mark(flags: np.ndarray, rows: np.ndarray, at: np.ndarray, words: pa.Array) -> None:
        seen = np.bincount(at, minlength=len(words)) > 0
        at = (np.cumsum(seen) - 1)[at]
        which, phrase = trie.find(words.filter(pa.array(seen)).to_pylist())
        first = np.searchsorted(which, np.arange(seen.sum() + 1))
        count = np.diff(first)[at]
        for a, b in pieces(count, max(1, len(count))):
            flags[np.repeat(rows[a:b], count[a:b]), phrase[spans(first[at[a:b]], count[a:b])]] = True

    def cut(batch: pa.RecordBatch, df: np.ndarray) -> pa.RecordBatch:
        size = batch.num_rows
        ok = batch["ok"].to_numpy(zero_copy_only=False)
        rows, at, words = encoded(batch["t"])
        dl = _counts(batch["t"])
        ids = numbers(words)[at]
        keys, tf = np.unique(rows[ids >= 0] * wide + ids[ids >= 0], return_counts=True)
        owner, ids = keys // max(1, wide), keys % max(1, wide)
        df += np.bincount(ids, minlength=wide)
        found = []
        for kind, name in enumerate("rhs"):
            flags = np.zeros((size, phrases), bool)
            if name == "r":  # without runs of its own a text has its terms as runs
                mine = (ok & batch["r"].is_null().to_numpy(zero_copy_only=False))[rows]
                mark(flags, rows[mine], at[mine], words)
            mark(flags, *encoded(batch[name]))
            row, phrase = np.nonzero(flags)
            found.append((row, phrase + kind * phrases))
        for kind, name in enumerate(("ht", "st")):
            row, place, named = encoded(batch[name])
            term = numbers(named)[place]
            found.append((row[term >= 0], term[term >= 0] + 3 * phrases + kind * wide))
        row, feature = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        none = pa.nulls(size, pa.int64())
        arrays = [batch["chunk_id"], none, none, pa.array(dl), _lists(owner, ids, size), _lists(owner, tf, size), _lists(row[order], feature[order], size)]
        return pa.RecordBatch.from_arrays(arrays, names).filter(batch["ok"])

    names = ["chunk_id", "n", "texts", "dl", "ids", "tf", "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, texts, length, kind = np.zeros(wide, np.int64), 0, 0, 0, None
        for batch in batches:
            sizes = _counts(batch["t"])
            n, texts, length, kind = n + batch.num_rows, texts + batch.num_rows - batch["t"].null_count, length + int(sizes.sum()), batch["chunk_id"].type
            for a, b in pieces(sizes, max(1, 4 * BLOCK // max(1, phrases))):
                yield cut(batch.slice(a, b - a), df)
        if n:
            held = np.flatnonzero(df)
            one = lambda v: pa.array([v], pa.int64())
            whole = lambda v: _lists(np.zeros(len(v), np.int64), v, 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), one(n), one(texts), one(length), whole(held), whole(df[held]), whole(held[:0])], names)

    return run


@dataclass(frozen=True)
class Weights:
    """The queries of each item with their weights: of item i those from ``first[i]`` to ``first[i + 1]``."""

    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(item: np.ndarray, query: np.ndarray, weight: np.ndarray, items: int) -> Weights:
        order = np.argsort(item, kind="stable")
        return Weights(np.searchsorted(item[order], np.arange(items + 1)), query[order], weight[order].astype(np.float64))

    def add(self, total: np.ndarray, rows: np.ndarray, items: np.ndarray, times: np.ndarray | None = None) -> None:
        """Add to ``total``[row, query] the weight of each item, or so many times it. Rows are sorted."""
        count = np.diff(self.first)[items]
        for a, b in pieces(count, max(1, len(count))):
            n, at = count[a:b], spans(self.first[items[a:b]], count[a:b])
            low, high = rows[a], rows[b - 1] + 1
            w = self.weight[at] if times is None else self.weight[at] * np.repeat(times[a:b], n)
            cells = np.repeat((rows[a:b] - low) * total.shape[1], n) + self.query[at]
            total[low:high] += np.bincount(cells, w, (high - low) * total.shape[1]).reshape(-1, total.shape[1])


def scorer(queries: pa.Array, terms: Weights, features: Weights, phrased: int, rest: np.ndarray, saturate: Callable, top_k: int, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (chunk_id, dl, ids, tf, features) to (query_id, chunk_id, score), with all that may be among the ``top_k``.

    A hit has a posting, or, for the queries of ``rest``, a phrase: a feature below ``phrased``. Hits are left out only if
    ``top_k`` others of the task are better by more than ``slack``.
    """
    asked = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(asked, -np.inf)
        for whole in batches:
            for start in range(0, whole.num_rows, max(1, BLOCK // asked)):
                batch = whole.slice(start, max(1, BLOCK // asked))
                size = batch.num_rows
                flat = lambda c: batch[c].flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
                rows = lambda c: np.repeat(np.arange(size), _counts(batch[c]))  # noqa: E731, B023
                score, boost = np.zeros((size, asked)), np.zeros((size, asked))
                at, tf = rows("ids"), flat("tf")
                terms.add(score, at, flat("ids"), saturate(tf, batch["dl"].to_numpy(zero_copy_only=False)[at]))
                row, feature = rows("features"), flat("features")
                said = feature < phrased
                features.add(boost, row[said], feature[said])
                hit = np.where(rest, boost > 0, score > 0)
                features.add(boost, row[~said], feature[~said])
                score = np.where(hit, score + boost, -np.inf)
                if size > top_k:
                    floor = np.maximum(floor, np.partition(score, size - top_k, axis=0)[size - top_k])
                row, query = np.nonzero(hit & (score >= floor - slack))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), batch["chunk_id"].take(pa.array(row)), pa.array(score[row, query])], ["query_id", "chunk_id", "score"])

    return run

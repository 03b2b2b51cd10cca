"""The best hits of each query, kept by a task while blocks of scores go by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many hits are held before they are cut back to the best, or twice as many as then stayed.
HELD = 1 << 18


class Best:
    """All hits that may be among the ``top_k`` of a query by score, then by chunk id: none that ``top_k`` others surely beat.

    Scores closer than ``slack`` may tie once they are rounded, so such hits stay; of equal scores the lowest ids.
    """

    def __init__(self, queries: int, top_k: int, slack: float) -> None:
        self.top_k, self.slack, self.floor, self.most = top_k, slack, np.full(queries, -np.inf), HELD
        self.query: list[np.ndarray] = []
        self.chunk: list[pa.Array] = []
        self.score: list[np.ndarray] = []
        self.held = 0

    def add(self, query: np.ndarray, chunk: pa.Array, score: np.ndarray) -> None:
        """``score``: a row for each of these queries, a column for each of these chunks."""
        low, n = self.floor[query], len(chunk)
        if n > self.top_k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(score, n - self.top_k, axis=1)[:, n - self.top_k])
            self.floor[query] = low
        row, column = np.nonzero(score >= (low - self.slack)[:, None])
        self.query.append(query[row])
        self.chunk.append(chunk.take(pa.array(column)))
        self.score.append(score[row, column])
        self.held += len(row)
        if self.held > self.most:
            self.cut()
            self.most = max(HELD, 2 * self.held)

    def cut(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(query, chunk, score) of what is held, cut back to what may still be among the best."""
        if not self.query:
            return np.empty(0, np.int64), pa.nulls(0), np.empty(0)
        query, chunk, score = np.concatenate(self.query), pa.concat_arrays(self.chunk), np.concatenate(self.score)
        place = np.empty(len(query), np.int64)
        place[pc.array_sort_indices(chunk).to_numpy()] = np.arange(len(query))
        order = np.lexsort((place, -score, query))
        query, score, at = query[order], score[order], np.arange(len(query))
        first = np.flatnonzero(np.diff(query, prepend=-1))
        full = first[np.diff(first, append=len(query)) >= self.top_k]
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full + self.top_k - 1])
        fresh = (np.diff(query, prepend=-1) != 0) | (score != np.concatenate([[np.nan], score[:-1]]))[: len(query)]
        nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
        stay = (score >= self.floor[query] - self.slack) & (nth < self.top_k)
        query, chunk, score = query[stay], chunk.take(pa.array(order[stay])), score[stay]
        self.query, self.chunk, self.score, self.held = [query], [chunk], [score], len(query)
        return query, chunk, score

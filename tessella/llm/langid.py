"""Language identification by nearest centroids with distance-based rejection.

A text is the TF-IDF vector of the character n-grams (1 to 3) of its lower-case words, framed by blanks, normalised
to length one. Each language keeps several centroids, found by spherical k-means over its training vectors. A text
gets the language of the centroid of largest cosine. It is rejected if that cosine is below what all but a small
quantile of the language's own training texts reach with that language's centroids.

The fit uses at most ``per_language`` rows of each language (those whose keys and texts hash lowest) and at most
``most_rows`` of all, spread evenly over the languages: the bound of the sample. Its grams are counted in Spark; those
of at least ``least_rows`` rows are features, whatever their number, and only their counts reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a text whose grams are all unknown
gets the most frequent language, score 0, rejected; with nothing to learn from all are ``und``; a null language is
never learnt; repeated rows are classified again and learnt from once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessella.llm.common import bounded_sample, fold, letter_words, text_or_empty
from tessella.session import discard, durable, ship_package

LONGEST = 3
UNKNOWN = "und"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


def tf_idf(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.linalg.norm(v) if len(v) else v


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


@dataclass
class CentroidModel:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray
    vocabulary: dict[str, int]
    idf: np.ndarray
    _words: dict[str, np.ndarray | None] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_columns"} | {"_words": {}}

    @cached_property
    def _columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.centroids.T)

    def sparse(self, counts: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of word counts, and the values of the normalised TF-IDF vector there."""
        known, vocabulary = self._words, self.vocabulary
        if len(known) > 200_000:
            known.clear()
        parts, times = [], []
        for w, n in counts.items():
            ids = known.get(w)
            if ids is None:
                ids = np.array([vocabulary[g] for g in grams(w) if g in vocabulary], np.int32)
                if len(w) <= 48:
                    known[w] = ids
            if len(ids):
                parts.append(ids)
                times.append(n)
        if not parts:
            return np.empty(0, np.int64), np.empty(0)
        tf = np.bincount(np.concatenate(parts), weights=np.repeat(np.array(times, float), [len(p) for p in parts]), minlength=len(vocabulary))
        at = np.flatnonzero(tf)
        return at, tf_idf(tf[at], self.idf[at])

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        for i, t in enumerate(texts):
            if t is None or not self.languages:
                continue
            counts = Counter(letter_words(t))
            if not any(map(has_letter, counts)):
                continue
            at, values = self.sparse(counts)
            sims = values @ self._columns[at]  # only the rows of the grams that the text has
            k = int(sims.argmax())
            s, lang = float(sims[k]), int(self.owner[k])
            out[i] = (self.languages[lang] if s > 0 else self.languages[0], min(1.0, max(0.0, s)), s <= 0 or s < self.floors[lang])
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means with deterministic far-first seeding."""
    k = min(k, len(x))
    mean = x.mean(axis=0)
    centers = [x[int(np.argmax(x @ mean))]]
    far = 1 - x @ centers[0]
    while len(centers) < k:
        i = int(np.argsort(-far, kind="stable")[len(far) // 20])  # not the very farthest: that is an outlier
        centers.append(x[i])
        far = np.minimum(far, 1 - x @ x[i])
    c = np.stack(centers)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        new = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], vocabulary: list[tuple[str, int]], clusters: int = 4, quantile: float = 0.005, rounds: int = 12, seed: int = 0) -> CentroidModel:
    """Fit to rows (language, features, counts) over ``vocabulary`` (gram, rows that have it); languages are ordered by frequency, then name."""
    by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, at, tf in rows:
        by.setdefault(lang, []).append((at, tf))
    order = sorted(by, key=lambda lang: (-len(by[lang]), lang))
    idf = np.array([np.log((1 + len(rows)) / (1 + n)) + 1 for _, n in vocabulary])
    model = CentroidModel(order, np.empty(0, int), np.empty((0, len(vocabulary)), np.float32), np.zeros(len(order)), {g: i for i, (g, _) in enumerate(vocabulary)}, idf)
    centers, owner = [], []
    for i, lang in enumerate(order):  # one language is dense at a time
        held = [(at, tf) for at, tf in by[lang] if len(at)]
        x = np.zeros((max(1, len(held)), len(vocabulary)), np.float32)
        for j, (at, tf) in enumerate(held):
            x[j, at] = tf_idf(tf, idf[at])
        c = _kmeans(x, clusters, rounds, seed)
        model.floors[i] = np.quantile((x @ c.T).max(axis=1), quantile)
        centers.append(c)
        owner += [i] * len(c)
    model.centroids, model.owner = (np.concatenate(centers).astype(np.float32) if centers else model.centroids), np.array(owner, int)
    return model


def gram_rows(sample: DataFrame, least_rows: int) -> list[tuple[str, int]]:
    """(gram, rows that have it) of stored ``sample``(w), the most frequent first; every task counts its own rows before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for words in batch.column(0):
                held.update({g for w, _ in words.as_py() for g in grams(w)})
        names = list(held)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([held[g] for g in part], pa.int64())], ["g", "n"])

    counted = sample.select("w").mapInArrow(count, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_rows)
    return [(r["g"], r["n"]) for r in counted.orderBy(F.desc("n"), "g").collect()]


def train_languages(
    df: DataFrame, per_language: int = 500, fold_out: tuple[int, int] | None = (3, 1), key: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 5000, least_rows: int = 2
) -> CentroidModel:
    """Learn from rows with a language, without those whose crc32(key as text) has the remainder ``fold_out``."""
    ship_package(df.sparkSession)
    own = df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), text_or_empty(text).alias("t")).filter("lang is not null and k is not null")
    if fold_out:
        own = own.filter(fold("k", fold_out[0]) != fold_out[1])

    @arrow_udf("map<string,int>")
    def counts(t: pa.Array) -> pa.Array:
        return pa.array([sorted(Counter(letter_words(x)).items()) for x in t.to_pylist()], pa.map_(pa.string(), pa.int32()))

    sample = durable(bounded_sample(own, per_language, ["lang"], most_rows).select("k", "lang", F.xxhash64("t").alias("h"), counts("t").alias("w")))
    vocabulary = gram_rows(sample, least_rows)
    numbers = {g: i for i, (g, _) in enumerate(vocabulary)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words in batch.column(3):
                tf: Counter[int] = Counter()
                for w, n in words.as_py():
                    for g in grams(w):
                        if g in numbers:
                            tf[numbers[g]] += n
                rows.append(sorted(tf.items()))
            cols = [pa.array([[x[i] for x in r] for r in rows], pa.list_(pa.int32())) for i in range(2)]
            yield pa.record_batch([*batch.columns[:3], *cols], ["k", "lang", "h", "at", "tf"])

    kind = sample.schema["k"].dataType.simpleString()
    found = sample.mapInArrow(numbered, f"k {kind}, lang string, h bigint, at array<int>, tf array<int>").orderBy("k", "lang", "h").drop("k", "h").toArrow()
    discard(sample)
    rows = [(r.as_py(), np.asarray(a.values, np.int64), np.asarray(t.values, float)) for r, a, t in zip(*(found.column(c) for c in ("lang", "at", "tf")), strict=True)]
    return fit(rows, vocabulary)


def identify_languages(df: DataFrame, model: CentroidModel, fold_out: tuple[int, int] = (3, 1), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected) of each whole text."""
    ship_package(df.sparkSession)
    held = F.coalesce(fold(key, fold_out[0]) == fold_out[1], F.lit(False))
    source = df.select(key, held.alias("held_out"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores, rejected = zip(*model.classify(part.column(2).to_pylist()), strict=True)
                cols = [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.record_batch(cols, [key, "held_out", "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")

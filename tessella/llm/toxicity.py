"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (3 to 6) of a text's distinct words, framed by blanks, each counted once per text.
A gram's log-count ratio between toxic and other training texts scales it; grams whose ratio is not well supported
are left out, whatever their number; a logistic regression learns weights of the scaled features. Only text enters a score.

The fit uses at most ``per_class`` labelled rows of each label (those whose keys and texts hash lowest), the bound of
the sample; weights restore the true ratio of the labels. Rows that share a key count each on its own, so a key that
many rows have cannot enlarge the sample.

Defined results: a null or empty text has no features and gets the intercept's score; a null label is no label; a
document with labels of both kinds counts as toxic; without both classes to learn from every score is the share of
toxic labels (0 for no labels); repeated rows are scored again and learnt from once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessella.llm.common import bounded_sample, fold, letter_words, text_or_empty
from tessella.session import discard, durable, ship_package

SHORTEST, LONGEST = 3, 6


def grams(word: str) -> set[str]:
    """Character n-grams of a framed word; of a very long word, all of its whole length."""
    w = f" {word} "
    return {w[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    intercept: float
    _words: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        found: set[str] = set()
        known, weights = self._words, self.weights
        if len(known) > 200_000:
            known.clear()
        for w in set(letter_words(text)):
            hit = known.get(w)
            if hit is None:
                hit = tuple(g for g in grams(w) if g in weights)
                if len(w) <= 48:
                    known[w] = hit
            if hit:
                found.update(hit)
        z = self.intercept + math.fsum(weights[g] for g in found)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _logistic(rows: list[list[int]], scale: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of scaled binary features by accelerated gradient descent; ``share``: each row's part of the loss."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.array([i for r in rows for i in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    x = scale[flat]
    norm = np.bincount(owner, weights=x * x, minlength=len(rows)) + 1
    step = 1 / (0.25 * float((share * norm).sum()) + ridge)
    w, b = np.zeros(len(scale)), 0.0
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = np.bincount(owner, weights=x * pw[flat], minlength=len(rows)) + pb
        g = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        nw = pw - step * (np.bincount(flat, weights=x * g[owner], minlength=len(scale)) + ridge * pw)
        nb = pb - step * g.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(rows: list[list[int]], toxic: list[bool], class_sizes: tuple[int, int], ratios: list[tuple[str, float]], ridge: float = 1e-4, rounds: int = 400) -> ToxicityModel:
    """Fit to rows of gram numbers, positions in ``ratios`` (gram, log-count ratio); ``class_sizes``: all labelled rows without and with the label."""
    total = sum(class_sizes)
    prior = class_sizes[1] / total if total else 0.0
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    if not (n0 and n1):
        return ToxicityModel({}, math.log(prior / (1 - prior)) if 0 < prior < 1 else (700.0 if prior else -701.0))
    y = np.array(toxic, float)
    share = np.where(y > 0, class_sizes[1] / n1, class_sizes[0] / n0) / total
    scale = np.array([r for _, r in ratios])
    w, b = _logistic(rows, scale, y, share, ridge, rounds)
    return ToxicityModel({g: float(w[i] * r) for i, (g, r) in enumerate(ratios)}, float(b))


def gram_ratios(sample: DataFrame, sizes: tuple[int, int], support: float) -> list[tuple[str, float]]:
    """Log-count ratios of the supported grams of stored ``sample``(y, w), the best supported first, counted in Spark.

    Every task counts the grams of its own rows first, so the shuffle carries one row per gram and task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        other: Counter[str] = Counter()
        for batch in batches:
            for y, words in zip(batch.column(0), batch.column(1), strict=True):
                (toxic if y.as_py() else other).update({g for w in words.as_py() for g in grams(w)})
        names = list(toxic.keys() | other.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([toxic[g] for g in part], pa.int64()), pa.array([other[g] for g in part], pa.int64())], ["g", "p", "q"])

    n0, n1 = (F.lit(float(n)) for n in sizes)
    counted = sample.select("y", "w").mapInArrow(count, "g string, p bigint, q bigint").groupBy("g").agg(F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
    ratio = F.log((F.col("p") + 0.5) / (n1 + 1)) - F.log((F.col("q") + 0.5) / (n0 + 1))
    part = lambda x, row, column: F.when(x > 0, x * F.log(x * (n0 + n1) / (row * column))).otherwise(F.lit(0.0))
    with_it = F.col("p") + F.col("q")
    without = n0 + n1 - with_it
    # The root of twice the deviance of the 2 x 2 table: how well the ratio is supported, zero counts included.
    deviance = part(F.col("p"), with_it, n1) + part(F.col("q"), with_it, n0) + part(n1 - F.col("p"), without, n1) + part(n0 - F.col("q"), without, n0)
    strong = counted.select("g", ratio.alias("r"), F.round(F.sqrt(F.greatest(F.lit(0.0), 2 * deviance)), 9).alias("z")).filter(F.col("z") >= support)
    return [(r["g"], r["r"]) for r in strong.orderBy(F.desc("z"), "g").collect()]


def train_toxicity(
    documents: DataFrame, labels: DataFrame, per_class: int = 2000, hold_out: int | None = 5, support: float = 4.0, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> ToxicityModel:
    """Learn from ``labels``; rows whose crc32(key as text) is divisible by ``hold_out`` are never learnt from."""
    ship_package(documents.sparkSession)
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if hold_out:
        own = own.filter(fold(key, hold_out) != 0)
    own = own.groupBy(F.col(key).alias("k")).agg((F.max(F.col(label)) > 0).alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    low = [own.filter(F.col("y") == F.lit(v)).orderBy(F.xxhash64("k"), "k").limit(per_class) for v in (False, True)]

    @arrow_udf("array<string>")
    def words(t: pa.Array) -> pa.Array:
        return pa.array([sorted(set(letter_words(x))) for x in t.to_pylist()], pa.list_(pa.string()))

    # At most 2 x per_class keys are broadcast, and of their rows at most as many are taken; the words of those are stored.
    chosen = F.broadcast(low[0].unionByName(low[1]))
    labelled = documents.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).join(chosen, "k")
    sample = durable(bounded_sample(labelled, per_class, ["y"]).select("k", "y", words("t").alias("w")))
    seen = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = (seen.get(False, 0), seen.get(True, 0))
    ratios = gram_ratios(sample, counts, support) if all(counts) else []
    at = {g: i for i, (g, _) in enumerate(ratios)}

    @arrow_udf("array<int>")
    def numbers(w: pa.Array) -> pa.Array:
        return pa.array([sorted({at[g] for word in x.as_py() for g in grams(word) if g in at}) for x in w], pa.list_(pa.int32()))

    picked = sample.select("k", "y", numbers("w").alias("i")).collect()
    discard(sample)
    picked.sort(key=lambda r: (r["k"], r["y"], r["i"]))
    return fit([r["i"] for r in picked], [r["y"] for r in picked], (sizes.get(False, 0), sizes.get(True, 0)), ratios)


def _scored(model: ToxicityModel, texts: pa.Array) -> list[float]:
    return [model.score(t) for t in texts.to_pylist()]


def toxicity_score(model: ToxicityModel, text: str | Column = "text") -> Column:
    """Score between 0 and 1 of a text column."""
    bare = ToxicityModel(model.weights, model.intercept)
    held: list[ToxicityModel] = []

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(ToxicityModel(bare.weights, bare.intercept))
        for t in batches:
            yield pa.array([s for at in range(0, len(t), 512) for s in _scored(held[0], t.slice(at, 512))], pa.float64())

    return score(text_or_empty(text))


def score_toxicity(df: DataFrame, model: ToxicityModel, hold_out: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each whole text."""
    ship_package(df.sparkSession)
    scored = df.select(key, F.coalesce(fold(key, hold_out) == 0, F.lit(False)).alias("held_out"), toxicity_score(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

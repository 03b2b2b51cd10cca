"""Secret scans: three base rules, and character Markov models for what no rule names.

Two first-order models, of random strings and of ordinary identifiers, are trained from labelled samples by counting
character pairs. A candidate (a long unbroken run of key characters that no base span overlaps) is a secret if its
mean log-likelihood ratio per character pair exceeds a threshold calibrated on the same samples. DataFrame functions
only: positions come from splitting a text at its matches and adding up the lengths on both sides of each cut.

Work is linear in the length of a text: no position is looked up in a whole text, long runs are scored in blocks, and
sums over the m matches of a text, their overlaps and the pieces of a masked text go by blocks of about the root of m.

Defined results: a null text is empty and has no spans; repeated rows are scanned again; spans count code points,
ends exclusive, in the order of (start, kind). ``scan_secrets`` keeps the columns of its input and adds one, whose
name the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import let
from tessella.llm.common import bounded_sample, text_or_empty
from tessella.session import durable

_KEYS = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
_BEFORE = _KEYS + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = _BEFORE + r"[A-Za-z0-9+/_.=-]+"
#: kind, pattern, what a match must be to count
RULES = (("assign", ASSIGN, _BEFORE + r"[A-Za-z0-9+/_.=-]{6,}"), ("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]+", "[0-9a-f]{24,}"))
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET)
_CODES = [ALPHABET.find(chr(i)) if chr(i) in ALPHABET else -1 for i in range(128)]
MIN_CANDIDATE = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _prefixes(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def before_each(values: Column, merge: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each integer of an array the merged ones before it (``zero`` merged with nothing)."""
    start = F.lit(zero)

    def blocked(v: Column, step: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda i: F.slice(v, i + 1, step))
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, _prefixes(F.transform(blocks, lambda b: F.aggregate(b, start, merge)), start, merge), lambda b, base: _prefixes(b, base, merge))))

    root = lambda v: F.ceil(F.sqrt(F.size(v))).cast("int")
    return let(values, lambda v: F.when(F.size(v) < 32, _prefixes(v, start, merge)).otherwise(let(root(v), lambda step: blocked(v, step))))


_FOUND = "array<struct<start:int,kind:int,end:int,t:string>>"


def find_spans(text: Column, kind: str, pattern: str, keep: str | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, t>>; those that don't match ``keep`` whole are dropped."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m"), m.alias("t")))
    rank = KINDS.index(kind)

    def placed(all_: Column) -> Column:
        at = before_each(F.transform(all_, lambda x: x["g"] + x["m"]), lambda a, b: a + b)
        spans = F.zip_with(all_, at, lambda x, a: F.struct((a + x["g"]).alias("start"), F.lit(rank).alias("kind"), (a + x["g"] + x["m"]).alias("end"), x["t"].alias("t")))
        return F.filter(spans, lambda s: s["t"].isNotNull() & (s["t"].rlike(f"^(?:{keep})$") if keep else F.lit(True)))

    # Most texts have no match worth a span; they are not cut at all.
    return F.when(text.rlike(keep or pattern), let(lengths, placed)).otherwise(F.array().cast(_FOUND))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three rules, ordered by start, then kind.

    A run of hexadecimal digits, or one behind AKIA, is matched whole or not at all, so their length goes into the
    pattern; a key with a short value hides what its value holds, so those are matched first and dropped then.
    """
    parts = [find_spans(text, kind, pattern, keep) if kind == "assign" else find_spans(text, kind, keep) for kind, pattern, keep in RULES]
    return F.array_sort(F.concat(*map(_bare, parts)))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio of each character pair (random over ordinary), row-major over the alphabet, and the threshold."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, text: Column) -> Column:
        """Mean ratio per pair of a string over the alphabet; null below two characters."""
        codes, ratios = F.lit(np.array(_CODES, np.int32)), F.lit(np.array(self.ratios, np.float64))
        add = lambda a, b: a + b

        def block(part: Column) -> Column:
            coded = F.transform(F.split(part, "", -1), lambda c: F.element_at(codes, F.ascii(c) + 1))
            pairs = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.element_at(ratios, a * _SIZE + b + 1))
            return F.aggregate(let(F.filter(coded, lambda c: c >= 0), pairs), F.lit(0.0), add)

        # Each block takes the first character of the next along, so that no pair is lost.
        total = F.aggregate(F.transform(F.regexp_extract_all(text, F.lit("(?s)(?=(.{1,513})).{1,512}"), F.lit(1)), block), F.lit(0.0), add)
        return F.when(F.length(text) > 1, total / (F.length(text) - 1))


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> MarkovModel:
    """Fit both models to ``samples``(label: 'random' or 'ordinary', text over the alphabet).

    Pair counts are aggregated in Spark: at most 2 x 67 x 67 rows reach the driver. The threshold lies midway between
    the 99.9th percentile of the ordinary samples' scores and the 1st of the random ones', both at candidate length.
    """
    pair = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))
    counts = np.full((2, _SIZE, _SIZE), smoothing)
    for r in samples.filter(F.length("text") > 1).select("label", F.explode(pair).alias("p")).groupBy("label", "p").count().collect():
        a, b = (ALPHABET.find(c) for c in r["p"])
        if a >= 0 and b >= 0:
            counts[int(r["label"] == "random"), a, b] += r["count"]
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    model = MarkovModel(tuple((logs[1] - logs[0]).ravel().tolist()), 0.0)
    scored = samples.filter(F.length("text") >= MIN_CANDIDATE).select("label", model.score(F.col("text")).alias("s"))
    ends = {r["label"]: (r["lo"], r["hi"]) for r in scored.groupBy("label").agg(F.percentile("s", F.lit(0.01)).alias("lo"), F.percentile("s", F.lit(0.999)).alias("hi")).collect()}
    ordinary, random = ends.get("ordinary", (0.0, 0.0))[1], ends.get("random", (0.5, 0.5))[0]
    return MarkovModel(model.ratios, max(ordinary, (ordinary + random) / 2))


def labelled_samples(documents: DataFrame, sample_rows: int = 1000, generated: int = 3000, per_document: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled strings: generated hexadecimal, base-64 and alphanumeric keys against identifiers of the corpus.

    Identifiers are runs of four neighbouring words of at most ``sample_rows`` documents (different rows of the lowest
    hashes) and at most ``per_document`` of each, spread evenly over its whole text: the bounds of this fit. What a
    base rule matches is left out.
    """
    spark: SparkSession = documents.sparkSession
    ids = spark.range(generated)
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    size = (F.lit(MIN_CANDIDATE) + F.pmod("id", F.lit(21))).cast("int")
    random = ids.select(F.explode(F.array(F.substring(digest, F.lit(1), size), F.substring(b64, F.lit(1), size), F.upper(F.substring(F.regexp_replace(b64, "[+/]", "7"), F.lit(1), size)))).alias("text"))
    rows = documents.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).filter(F.col("k").isNotNull())
    chosen = durable(bounded_sample(rows, sample_rows))  # else the optimiser moves the patterns below in front of the join, to all documents
    for _, pattern, _ in RULES[:2]:
        chosen = chosen.withColumn("t", F.regexp_replace("t", pattern, " "))
    words = F.regexp_extract_all(F.regexp_replace("t", RULES[2][2], " "), F.lit("([A-Za-z0-9]{3,15})"), F.lit(1))
    ordinary = chosen.select(words.alias("w")).filter(F.size("w") >= 4)
    join = lambda i: F.call_function("array_join", F.slice("w", i, 4), F.when(i % 3 == 0, F.lit("_")).when(i % 3 == 1, F.lit("-")).otherwise(F.lit("")))
    step = F.greatest(F.lit(4), F.ceil(F.size("w") / per_document)).cast("int")
    at = F.sequence(F.lit(1), F.size("w") - 3, step)
    ordinary = ordinary.select(F.explode(F.transform(at, join)).alias("text"))
    return random.select(F.lit("random").alias("label"), "text").unionByName(ordinary.select(F.lit("ordinary").alias("label"), "text"))


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that no span of ``base`` overlaps; both ordered by start, ``spans`` of the last kind."""
    last = len(KINDS) - 1
    far = 2**31 - 1
    longest = lambda v, of, none: before_each(F.transform(v, lambda s: F.when(s["kind"] < last, of(s)).otherwise(F.lit(none))), _larger, none)

    def kept(v: Column) -> Column:
        ended = longest(v, lambda s: s["end"], 0)
        begun = F.reverse(longest(F.reverse(v), lambda s: -s["start"], -far))  # what stands behind a span: its start, negated
        sides = F.zip_with(ended, begun, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
        flagged = F.zip_with(v, sides, lambda s, x: F.struct(s.alias("s"), ((s["kind"] == last) & (x["e"] <= s["start"]) & (-x["b"] >= s["end"])).alias("ok")))
        return F.transform(F.filter(flagged, lambda f: f["ok"]), lambda f: f["s"])

    both = lambda v, b: F.when((F.size(v) == 0) | (F.size(b) == 0), v).otherwise(let(F.array_sort(F.concat(v, b)), kept))
    return let(spans, lambda v: let(base, lambda b: both(v, b)))


def markov_spans(text: Column, base: Column, model: MarkovModel) -> Column:
    """Candidates that no base span overlaps and that look random."""
    random = F.filter(find_spans(text, "markov", CANDIDATE), lambda s: model.score(s["t"]) > model.threshold)
    return _apart(_bare(random), base)


def scan_secrets(df: DataFrame, model: MarkovModel, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """Add the base spans and all spans, each array<struct<start, kind, end>> (kind: index in ``KINDS``)."""
    t = text_or_empty(text)
    with_base = df.withColumn(base, base_spans(t))
    return with_base.withColumn(spans, F.array_sort(F.concat(F.col(base), markov_spans(t, F.col(base), model))))


def render_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every covered stretch (overlapping spans as one) replaced by ``mask``; ``spans`` are ordered by start."""

    def masked(s: Column) -> Column:
        seen = before_each(F.transform(s, lambda x: x["end"]), _larger)
        kept = F.zip_with(s, seen, lambda x, at: F.struct(at.alias("a"), x["start"].alias("b")))
        gaps = F.filter(kept, lambda g: g["b"] >= g["a"])
        tail = let(F.array_max(F.transform(s, lambda x: x["end"])), lambda end: F.substring(text, end + 1, F.length(text)))
        return F.concat(let(gaps, lambda g: let(F.ceil(F.sqrt(F.size(g))).cast("int"), lambda step: blocks(g, step))), tail)

    def blocks(gaps: Column, step: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(gaps) - 1, step), lambda i: F.slice(gaps, i + 1, step))
        return F.array_join(F.transform(cut, lambda block: let(F.element_at(block, 1)["a"], lambda at: one(block, at))), "")

    def one(block: Column, at: Column) -> Column:
        """A block's own stretch of the text is cut out first, then its gaps from that."""
        part = F.substring(text, at + 1, F.element_at(block, -1)["b"] - at)
        return let(part, lambda p: F.array_join(F.transform(block, lambda g: F.concat(F.substring(p, g["a"] - at + 1, g["b"] - g["a"]), F.lit(mask))), ""))

    return F.when(F.size(spans) > 0, let(spans, masked)).otherwise(text)

"""Text expressions: terms of mixed ASCII and CJK text, token estimates, trims, phrases and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
RUN = f"([A-Za-z0-9_]+|[{CJK}]+)"
STOP_TERMS = tuple("几 要 及 或 与 和 在 是 了 的 是否 如何 怎么 什么".split())
#: Python's str.strip() also removes the four ASCII separators.
_BLANK = "[\\s\\x1c-\\x1f]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an outer expression runs again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_blank(c: str | Column) -> Column:
    """Strip all Unicode white space at both ends (Spark's trim takes blanks only)."""
    return F.regexp_replace(as_col(c), f"(?U)^{_BLANK}+|{_BLANK}+\\z", "")


def split_lines(c: str | Column) -> Column:
    """Lines at every Unicode line boundary; a last line break makes no extra line, an empty text no line."""
    text = as_col(c)
    body = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def token_estimate(c: str | Column) -> Column:
    """1.5 per CJK character and 1.3 per word, rounded down, plus one."""
    text = as_col(c)
    cjk, words = F.regexp_count(text, F.lit(f"[{CJK}]")), F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))
    return (cjk * F.lit(1.5) + words * F.lit(1.3)).cast("int") + 1


def ngrams(c: str | Column, n: int) -> Column:
    """All substrings of ``n`` characters, in order."""
    text = as_col(c)
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def _runs(c: str | Column) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(RUN), F.lit(1))


def terms(c: str | Column) -> Column:
    """Search terms in order, repeats kept: lower-case words; single CJK characters; bi- and trigrams of CJK runs and whole runs of 2 to 6."""

    def of(run: Column) -> Column:
        n = F.length(run)
        whole = F.when(n.between(2, 6), F.array(run)).otherwise(F.array().cast("array<string>"))
        cjk = F.when(n == 1, F.array(run)).otherwise(F.concat(ngrams(run, 2), ngrams(run, 3), whole))
        return F.when(run.rlike("^[A-Za-z0-9_]"), F.array(F.lower(run))).otherwise(cjk)

    plain = F.transform(_runs(c), F.lower)
    mixed = F.filter(F.flatten(F.transform(_runs(c), of)), lambda t: ~t.isin(*STOP_TERMS))
    # Texts without CJK characters need no n-grams and no stop terms.
    return F.when(as_col(c).rlike(f"[{CJK}]"), mixed).otherwise(plain)


def phrases(c: str | Column) -> Column:
    """Distinct phrases of a query, in order: words of 2 characters or more, short CJK runs, CJK tri- and tetragrams."""

    def of(run: Column) -> Column:
        low = F.lower(run)
        word = F.when(F.length(run) >= 2, F.array(low)).otherwise(F.array().cast("array<string>"))
        short = F.when(F.length(run).between(2, 8), F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike("^[A-Za-z0-9_]"), word).otherwise(F.concat(short, ngrams(run, 3), ngrams(run, 4)))

    return F.array_distinct(F.filter(F.flatten(F.transform(_runs(c), of)), lambda p: ~p.isin(*STOP_TERMS)))


def compact(c: str | Column) -> Column:
    """Lower case without white space, punctuation and underscores."""
    return F.regexp_replace(F.lower(as_col(c)), "(?U)[\\s\\W_]+", "")


def squeeze(c: str | Column) -> Column:
    """Lower case without white space, for containment tests."""
    return F.regexp_replace(F.lower(as_col(c)), "(?U)\\s+", "")


def feature_tokens(c: str | Column) -> Column:
    """Tokens of the hashed embedding: lower-case words, CJK characters and CJK bigrams."""

    def of(run: Column) -> Column:
        return F.when(run.rlike("^[a-z0-9_]"), F.array(run)).otherwise(F.concat(ngrams(run, 1), ngrams(run, 2)))

    return F.flatten(F.transform(_runs(F.lower(as_col(c))), of))


def char_windows(c: str | Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that step by size - overlap (at least 1); blank ones are dropped."""
    text = trim_blank(c)
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), lambda w: trim_blank(w) != "")

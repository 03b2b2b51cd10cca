"""Page health, risk-led sampling and review reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_USUAL = "，。；：、！？（）“”" + "!$&'()*+,./<=>?@[]^`{|}~%#" + '"-' + "\\"
_ODD = "(?U)[^\\w\\s\\u4e00-\\u9fff" + "".join("\\" + c for c in _USUAL) + "]"


def page_signals(pages: DataFrame, text: str = "text", ocr: Column | None = None) -> DataFrame:
    """Add char_count, garbled_ratio, hyphen_breaks, is_blank and health_score (0 to 1, lower: review first)."""
    t = F.coalesce(F.col(text), F.lit(""))
    confidence = ocr if ocr is not None else (F.coalesce(F.col("ocr_confidence"), F.lit(1.0)) if "ocr_confidence" in pages.columns else F.lit(1.0))
    n = F.length(t)
    garbled = F.when(n > 0, F.regexp_count(t, F.lit(_ODD)) / n).otherwise(1.0)
    breaks = F.regexp_count(t, F.lit("[A-Za-z]-\\n[A-Za-z]"))
    held = pages.withColumns({"__n": n, "__g": garbled, "__b": breaks, "__c": confidence.cast("double")})
    score = 1.0 - F.least(F.lit(0.5), F.col("__g") * 5.0) - (1.0 - F.col("__c")) * 0.5 - F.least(F.lit(0.2), F.col("__b") * F.lit(0.01))
    return held.withColumns({
        "char_count": F.col("__n"), "garbled_ratio": F.round("__g", 4), "hyphen_breaks": F.col("__b"), "is_blank": F.col("__n") < 10,
        "health_score": F.when(F.col("__n") < 10, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 4)),
    }).drop("__n", "__g", "__b", "__c")


def plan_samples(signals: DataFrame, stratum: Column, order: list[str], least: int = 30, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Pages to review, with ``part``: per stratum, half the sample by lowest health, half in hash order of the rest.

    A stratum's sample has min(all, max(least, ceil(share x all))) pages.
    """
    per = signals.withColumn("__s", stratum)
    sizes = per.groupBy("__s").agg(F.count(F.lit(1)).alias("__all"))
    k = F.least(F.col("__all"), F.greatest(F.lit(least), F.ceil(F.col("__all") * F.lit(share)))).cast("bigint")
    ranked = per.join(sizes, "__s").withColumn("__k", k).withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy("health_score", *order)))
    half = F.floor(F.col("__k") / 2)
    risk = F.col("__r") <= half
    mixed = ranked.withColumn("__risk", risk).withColumn("__h", F.row_number().over(Window.partitionBy("__s", "__risk").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in order], F.lit(seed)), *order)))
    chosen = mixed.filter(F.col("__risk") | (F.col("__h") <= F.col("__k") - half))
    return chosen.withColumn("part", F.when(F.col("__risk"), "risk").otherwise("random")).drop("__s", "__all", "__k", "__r", "__risk", "__h")


def review_report(results: DataFrame, char_accuracy: float = 0.99, table_f1: float = 0.9, key_field: float = 0.98, release: float = 0.95) -> DataFrame:
    """One row: sampled, passed, failed, pass_rate, release_ok; criteria that were not measured don't count."""
    fine = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(True))
    ok = (F.col("char_accuracy") >= char_accuracy) & fine("table_f1", table_f1) & fine("key_field_accuracy", key_field)
    rate = F.coalesce(F.round(F.avg(ok.cast("int")), 4), F.lit(0.0))
    return results.agg(
        F.count(F.lit(1)).alias("sampled"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("passed"), F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias("failed"),
        rate.alias("pass_rate"), (rate >= release).alias("release_ok"),
    )

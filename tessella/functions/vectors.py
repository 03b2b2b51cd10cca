"""Vector expressions and deterministic embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import as_col, feature_tokens, let


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product over the shorter length."""
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def norm_or_one(a: str | Column) -> Column:
    return let(norm(a), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; a zero vector counts as of norm 1, so its cosine is 0."""
    return dot(a, b) / (norm_or_one(a) * norm_or_one(b))


def feature_index(token: Column, dim: int) -> Column:
    """Position of a token: the first 32 bits of its SHA-256, modulo ``dim``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def feature_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hashed_embedding(c: str | Column, dim: int = 128) -> Column:
    """Signed feature hashing of a text, of length 1: built-in functions only."""
    hashed = F.transform(feature_tokens(c), lambda t: F.struct(feature_index(t, dim).alias("i"), feature_sign(t).alias("s")))
    zero = F.array_repeat(F.lit(0.0), dim)
    # One pass over the tokens into a map-free dense vector would rewrite it per token; summing per position is cheaper sorted.
    ordered = F.array_sort(hashed)
    summed = F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("s"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")).alias("m")),
        lambda a, x: F.struct(
            x["i"].alias("i"),
            F.when(a["i"] == x["i"], a["s"] + x["s"]).otherwise(x["s"]).alias("s"),
            F.when((a["i"] == x["i"]) | (a["i"] < 0), a["m"]).otherwise(F.map_concat(a["m"], F.create_map(a["i"], a["s"]))).alias("m"),
        ),
        lambda a: F.when(a["i"] < 0, a["m"]).otherwise(F.map_concat(a["m"], F.create_map(a["i"], a["s"]))),
    )
    return let(summed, lambda m: normalised(F.transform(zero, lambda z, i: F.coalesce(F.element_at(m, i), z))))


def normalised(v: Column) -> Column:
    return let(v, lambda w: let(norm_or_one(w), lambda n: F.transform(w, lambda x: x / n)))


def digest_vector(text: str, dim: int) -> list[float]:
    """A unit vector from BLAKE2b digests of ``text:0``, ``text:1``, ...; equal texts, equal vectors."""
    raw = b"".join(hashlib.blake2b(f"{text}:{i}".encode(), digest_size=32).digest() for i in range(-(-dim // 32)))
    values = np.frombuffer(raw[:dim], np.uint8) / 127.5 - 1.0
    return (values / (np.sqrt((values * values).sum()) or 1.0)).tolist()


def digest_embedding(c: str | Column, dim: int = 256) -> Column:
    """``digest_vector`` of each text, in Arrow batches: Spark has no BLAKE2b."""
    dim = max(2, int(dim))

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest_vector(t or "", dim))

    return embed(as_col(c))

"""Metadata filters as columns: the default keeps the latest versions, a user's filter may override it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = {"is_latest": True}


def parse_filter(text: str | None) -> dict[str, Any]:
    """A JSON object, or nothing."""
    if not text:
        return {}
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a metadata filter must be a JSON object")
    return value


def filter_column(df: DataFrame, conditions: Mapping[str, Any]) -> Column:
    """All conditions hold: equal to a scalar, in a list, or (array columns) any value shared. A missing column is null."""
    types = {f.name: f.dataType for f in df.schema}

    def one(name: str, want: Any) -> Column:
        many = list(want) if isinstance(want, (list, tuple, set, frozenset)) else None
        if name not in types:
            return F.lit(want is None or (many is not None and None in many))
        c = F.col(name)
        if isinstance(types[name], T.ArrayType):
            allowed = many if many is not None else [want]
            return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in allowed])), F.lit(False)) if allowed else F.lit(False)
        if many is None:
            return c.eqNullSafe(F.lit(want))
        values = [v for v in many if v is not None]
        inside = F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)
        return inside | c.isNull() if None in many else inside

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in conditions.items()), F.lit(True))


def with_default(conditions: Mapping[str, Any] | None) -> dict[str, Any]:
    return {**DEFAULT, **(conditions or {})}


def apply_filter(df: DataFrame, conditions: Mapping[str, Any] | None, default: bool = True) -> DataFrame:
    own = with_default(conditions) if default else dict(conditions or {})
    return df.filter(filter_column(df, own)) if own else df

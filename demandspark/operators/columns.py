"""Columns by type class, and user lists checked against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def pick(available: Sequence[str], wanted: Sequence[str] | None) -> list[str]:
    """The wanted columns that exist, in table order; all of them without a list."""
    return [c for c in available if wanted is None or c in set(wanted)]


def stack(sections: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a section lacks is null there."""
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out

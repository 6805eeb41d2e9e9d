"""One-hot encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import TEXT, kind, ref

MAX_CATEGORIES = 1000


def fit_categories(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> list[str]:
    """The sorted distinct values. More than `max_categories` of them is an error: each becomes a column."""
    if kind(df, column) != TEXT:
        raise ValueError(f"column {column!r} is {kind(df, column)}, text is needed")
    found = (df.select(ref(column).alias("v")).where("v IS NOT NULL").distinct()
             .limit(max_categories + 1).collect())
    if not found:
        raise ValueError(f"column {column!r} holds no values to encode")
    if len(found) > max_categories:
        raise ValueError(f"column {column!r} has more than {max_categories} distinct values")
    return sorted((r["v"] for r in found), key=lambda v: v.encode())


def apply_one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    clash = [v for v in categories if v in df.columns]
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    return df.select("*", *[ref(column).eqNullSafe(F.lit(v)).cast("int").alias(v) for v in categories])


def one_hot(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """One 0/1 column per distinct value, named by it, in sorted order; NULL gives zeros."""
    return apply_one_hot(df, column, fit_categories(df, column, max_categories))

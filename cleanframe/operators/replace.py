"""Find and replace in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import TEXT, data_type, kind, ref, require, typed_literal
from cleanframe.functions.text import clean_text, replace_literal, replace_regex

# Ways of replacing.
METHODS = ("substring", "full replace", "regex")


def find_replace(df: DataFrame, column: str, how: str, find, put, every: bool = False) -> DataFrame:
    """`substring` and `regex` work on text, `full replace` on any type. `every` lets regex replace all matches."""
    require(df, column)
    if how == "full replace":
        dtype = data_type(df, column)
        hit = ref(column) == typed_literal(find, dtype)
        return df.withColumn(column, F.when(hit, typed_literal(put, dtype)).otherwise(ref(column)))
    if how not in METHODS:
        raise ValueError(f"unknown method {how!r}; choose one of {', '.join(METHODS)}")
    if kind(df, column) != TEXT:
        raise ValueError(f"column {column!r} is {kind(df, column)}, text is needed")
    if how == "substring":
        return df.withColumn(column, replace_literal(ref(column), find, put))
    return df.withColumn(column, replace_regex(ref(column), find, put, every))


def clean_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.withColumn(column, clean_text(ref(column)))

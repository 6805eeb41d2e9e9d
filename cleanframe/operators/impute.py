"""Filling NULLs: `fit` reads one statistic, `fill` is row-wise and works on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import INTEGER, data_type, kind, ref, require, require_numeric, typed_literal
from cleanframe.operators.profile import median, most_common

# Ways of filling.
METHODS = ("AVG", "MEDIAN", "MCV", "CUSTOM")


def fit(df: DataFrame, column: str, how: str, value=None):
    """The value to fill with. Numbers without data give 0; halves go to the even integer in integer columns."""
    require(df, column)
    how = how.upper()
    if how == "CUSTOM":
        return value
    if how == "MCV":
        return most_common(df, column).first()["value"]
    if how not in METHODS:
        raise ValueError(f"unknown method {how!r}; choose one of {', '.join(METHODS)}")
    require_numeric(df, column)
    found = df.agg(F.avg(ref(column))).first()[0] if how == "AVG" else median(df, column)
    found = found or 0
    return int(round(found)) if kind(df, column) == INTEGER else float(found)


def fill(df: DataFrame, column: str, value) -> DataFrame:
    require(df, column)
    return df.withColumn(column, F.coalesce(ref(column), typed_literal(value, data_type(df, column))))


def impute(df: DataFrame, column: str, how: str, value=None) -> DataFrame:
    """AVG, MEDIAN, MCV (most common value) or CUSTOM."""
    return fill(df, column, fit(df, column, how, value))

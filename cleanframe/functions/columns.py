"""Column references, typed literals and the folded type names shown to users."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folded type names.
INTEGER, DOUBLE, REAL, TEXT, TIMESTAMP, BIT = "integer", "double", "real", "text", "timestamp", "bit"
NUMERIC = (INTEGER, DOUBLE, REAL)

TREE_BOUNDS = 16


def ref(name: str) -> Column:
    """Reference a column by its literal name; blanks, dots and brackets are allowed in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def data_type(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def friendly_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(dtype, T.DoubleType):
        return DOUBLE
    if isinstance(dtype, T.FloatType):
        return REAL
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    if isinstance(dtype, T.BooleanType):
        return BIT
    return dtype.simpleString()


def kind(df: DataFrame, name: str) -> str:
    return friendly_type(data_type(df, name))


def require_numeric(df: DataFrame, name: str) -> None:
    if kind(df, name) not in NUMERIC:
        raise ValueError(f"column {name!r} is {kind(df, name)}, a number is needed")


def number_or_null(df: DataFrame, name: str) -> Column:
    """A numeric column in which NaN counts as missing."""
    require_numeric(df, name)
    value = ref(name)
    return F.when(~F.isnan(value), value) if kind(df, name) in (DOUBLE, REAL) else value


def typed_literal(value, dtype: T.DataType) -> Column:
    """A literal of exactly `dtype`. Text is parsed by an ANSI cast, so a bad value fails the query."""
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    if isinstance(value, T.Row):
        return F.struct(*[typed_literal(v, f.dataType).alias(f.name) for v, f in zip(value, dtype.fields)])
    if (isinstance(value, float) and isinstance(dtype, T.DoubleType)) or (
            isinstance(value, str) and isinstance(dtype, T.StringType)):
        return F.lit(value)
    return F.lit(value).cast(dtype)


def bisect(bounds: list[Column], reached) -> Column:
    """How many of the ascending bounds are reached, where `reached(bound)` holds for the first so many of them.

    Binary search: a few bounds as a tree of comparisons, many by halving steps over a constant array (past its
    end the bound is NULL and not reached).
    """
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(reached(bounds[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    if len(bounds) <= TREE_BOUNDS:
        return search(0, len(bounds))
    array = F.array(*bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        reached(F.get(array, at + step - 1)), at + step).otherwise(at))


def bound_index(value: Column, edges: list[float]) -> Column:
    """How many of the given ascending edges lie strictly below `value`; NULL for a NULL value."""
    index = bisect([F.lit(float(e)) for e in edges], lambda e: e < value.cast("double"))
    return F.when(value.isNotNull(), index)

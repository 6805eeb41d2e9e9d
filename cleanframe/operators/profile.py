"""Column statistics, table profile, histograms and value counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.bins import equal_width_edges, labels
from cleanframe.functions.columns import NUMERIC, TIMESTAMP, bound_index, kind, number_or_null, ref, require, require_numeric
from cleanframe.plans.ordering import values_at_ranks

# Bins of the numeric histogram and digits of its labels.
HISTOGRAM_BINS = 10
HISTOGRAM_DIGITS = 3


def _or_zero(value: Column, zero_if_empty: bool) -> Column:
    return F.coalesce(value, F.lit(0)) if zero_if_empty else value


def average(column: str, zero_if_empty: bool = True) -> Column:
    return _or_zero(F.avg(ref(column)), zero_if_empty).cast("double")


def minimum(column: str, zero_if_empty: bool = True) -> Column:
    return _or_zero(F.min(ref(column)), zero_if_empty)


def maximum(column: str, zero_if_empty: bool = True) -> Column:
    return _or_zero(F.max(ref(column)), zero_if_empty)


def empty_count(column: str) -> Column:
    return F.count_if(ref(column).isNull())


def most_common(df: DataFrame, column: str) -> DataFrame:
    """One row (value, n): the most frequent non-NULL value, the smallest of equals. NULL for no data.

    A count per value followed by a minimum; the built-in `mode` would hold every distinct value in one buffer.
    """
    counted = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("v")).agg(F.count("*").alias("n"))
    best = counted.agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("v"))).alias("best"))
    return best.select(F.col("best.v").alias("value"), (-F.col("best.rank")).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) ascending by value, NULLs left out."""
    require(df, column)
    return (df.where(ref(column).isNotNull()).groupBy(ref(column).alias("value"))
            .agg(F.count("*").alias("n")).orderBy("value"))


def row_count(df: DataFrame) -> int:
    return df.count()


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    require(df, *columns)
    return df.select(*[ref(c) for c in columns]).distinct()


def median(df: DataFrame, column: str) -> float | None:
    """Exact median, the mean of the two middle values; None for no data."""
    require_numeric(df, column)
    _, middle = values_at_ranks(df, column, lambda n: [(n - 1) // 2, n // 2])
    return sum(float(v) for v in middle) / len(middle) if middle else None


def mean_and_std(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """Population mean and standard deviation; NaN counts as missing."""
    value = number_or_null(df, column)
    row = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    return row["m"], row["s"]


def table_profile(df: DataFrame, columns: list[str] | None = None, id_col: str = "id",
                  zero_if_empty: bool = True) -> DataFrame:
    """One row per column: average, minimum, maximum (numbers only), most_common as text, n_empty.

    Averages, limits and NULL counts of all columns come from one aggregate over one scan. Each most common
    value is a count per value, which reads just its own column.
    """
    columns = columns or [c for c in df.columns if c != id_col]
    require(df, *columns)
    wide, rows = [], []
    for i, name in enumerate(columns):
        number = kind(df, name) in NUMERIC
        wide.append(empty_count(name).alias(f"e{i}"))
        if number:
            wide += [average(name, zero_if_empty).alias(f"a{i}"),
                     minimum(name, zero_if_empty).cast("double").alias(f"l{i}"),
                     maximum(name, zero_if_empty).cast("double").alias(f"h{i}")]
        blank = F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(name).alias("column"), F.lit(kind(df, name)).alias("type"),
            (F.col(f"a{i}") if number else blank).alias("average"),
            (F.col(f"l{i}") if number else blank).alias("minimum"),
            (F.col(f"h{i}") if number else blank).alias("maximum"),
            F.col(f"e{i}").alias("n_empty")))
    figures = df.agg(*wide).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    common = reduce(DataFrame.unionByName, [
        most_common(df, name).select(F.lit(name).alias("column"), F.col("value").cast("string").alias("most_common"))
        for name in columns])
    return figures.join(common, "column").select(
        "column", "type", "average", "minimum", "maximum", "most_common", "n_empty")


def column_profile(df: DataFrame, column: str, zero_if_empty: bool = True) -> DataFrame:
    return table_profile(df, [column], zero_if_empty=zero_if_empty)


def as_number(df: DataFrame, column: str) -> Column:
    """The column as DOUBLE, NaN as NULL; a timestamp as microseconds since 1970."""
    if kind(df, column) == TIMESTAMP:
        return F.unix_micros(ref(column).cast("timestamp")).cast("double")
    return number_or_null(df, column).cast("double")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, label, n) for equal-width, right-closed bins over the column's range, empty bins included."""
    numbers = df.select(as_number(df, column).alias("x"))
    low, high = numbers.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, label string, n long")
    edges = equal_width_edges(low, high, bins)
    placed = numbers.select(bound_index(F.col("x"), edges).alias("b"))
    counted = placed.agg(*[F.count_if(F.col("b") == i).alias(f"n{i}") for i in range(1, bins + 1)])
    rows = [F.struct(F.lit(i).alias("bin"), F.lit(label).alias("label"), F.col(f"n{i}").alias("n"))
            for i, label in enumerate(labels(edges, HISTOGRAM_DIGITS), 1)]
    return counted.select(F.inline(F.array(*rows)))

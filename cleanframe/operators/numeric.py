"""Z-scores and bins; NaN counts as missing. The `fit_*` functions read a few numbers; the rest is row-wise and works on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.bins import check_increasing, equal_width_edges, labels
from cleanframe.functions.columns import bound_index, number_or_null
from cleanframe.operators.profile import mean_and_std
from cleanframe.plans.ordering import values_at_ranks

# Output names, label digits, and the share of its value by which a frequency edge is lowered.
NORM_NAME = "{column}_norm"
WIDTH_NAME = "{column}_intervals_eq_w_{bins}"
FREQUENCY_NAME = "{column}_intervals_eq_f_{bins}"
MANUAL_NAME = "{column}_intervals_custom"
BIN_DIGITS = 9
MANUAL_DIGITS = 3
FREQUENCY_STEP_DOWN = 1000


def apply_normalize(df: DataFrame, column: str, mean: float | None, std: float | None) -> DataFrame:
    """(x - mean) / std; a column without spread is copied."""
    x = number_or_null(df, column).cast("double")
    return df.withColumn(NORM_NAME.format(column=column), (x - F.lit(mean)) / F.lit(std) if std else x)


def normalize(df: DataFrame, column: str) -> DataFrame:
    return apply_normalize(df, column, *mean_and_std(df, column))


def fit_equal_width(df: DataFrame, column: str, bins: int) -> list[float]:
    value = number_or_null(df, column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        raise ValueError(f"column {column!r} holds no values")
    return equal_width_edges(low, high, bins)


def fit_equal_frequency(df: DataFrame, column: str, bins: int, mode: str = "lowered") -> list[float]:
    """Edges from exact order statistics of the non-NULL values.

    `lowered`: each k-th value from the smallest on (k = count // bins), lowered by a thousandth of itself.
    Values above the last edge, and a negative minimum, get no bin; repeated edges are an error.
    `quantile`: first values of equal shares plus the maximum, repeated edges merged; every value gets a bin.
    """
    df = df.select(number_or_null(df, column).alias(column))
    if bins < 1:
        raise ValueError("at least one bin is needed")
    if mode == "lowered":
        total, values = values_at_ranks(df, column, lambda n: range(0, n, n // bins) if n >= bins else [])
        if total < bins:
            raise ValueError(f"{bins} bins need at least as many values, there are {total}")
        edges = [float(v) - float(v) / FREQUENCY_STEP_DOWN for v in values]
        check_increasing(edges)
        return edges
    if mode != "quantile":
        raise ValueError(f"unknown mode {mode!r}; choose lowered or quantile")
    total, values = values_at_ranks(df, column, lambda n: [n * i // bins for i in range(bins)] + [n - 1])
    if not total:
        raise ValueError(f"column {column!r} holds no values")
    edges = sorted({float(v) for v in values})
    return edges if len(edges) > 1 else edges * 2


def apply_bins(df: DataFrame, column: str, edges: list[float], name: str, digits: int = BIN_DIGITS,
               close_first: bool = False, index_name: str | None = None) -> DataFrame:
    """Add the label '(lo, hi]' of the bin as `name`, and its number from 1 on as `index_name` if wanted.

    Values outside all bins get NULL. `close_first` puts the lowest edge itself into the first bin.
    """
    x = number_or_null(df, column).cast("double")
    index = bound_index(x, edges)
    if close_first:
        index = F.when(x == F.lit(float(edges[0])), F.lit(1)).otherwise(index)
    index = F.when((index >= 1) & (index < len(edges)), index)
    names = F.array(*[F.lit(text) for text in labels(edges, digits)])
    out = df.withColumn(name, F.when(index.isNotNull(), F.element_at(names, F.coalesce(index, F.lit(1)))))
    return out.withColumn(index_name, index) if index_name else out


def equal_width(df: DataFrame, column: str, bins: int, index_name: str | None = None) -> DataFrame:
    edges = fit_equal_width(df, column, bins)
    return apply_bins(df, column, edges, WIDTH_NAME.format(column=column, bins=bins), index_name=index_name)


def equal_frequency(df: DataFrame, column: str, bins: int, mode: str = "lowered",
                    index_name: str | None = None) -> DataFrame:
    edges = fit_equal_frequency(df, column, bins, mode)
    return apply_bins(df, column, edges, FREQUENCY_NAME.format(column=column, bins=bins),
                      close_first=mode == "quantile", index_name=index_name)


def manual_bins(df: DataFrame, column: str, edges: str | list[int], index_name: str | None = None) -> DataFrame:
    """Edges as a list or as text "a,b,c"."""
    if isinstance(edges, str):
        edges = [int(e) for e in edges.split(",")]
    check_increasing(edges)
    return apply_bins(df, column, edges, MANUAL_NAME.format(column=column), MANUAL_DIGITS, index_name=index_name)


def discretize(df: DataFrame, column: str, how: str, bins: int | None = None, edges=None, **options) -> DataFrame:
    """`eq-width` and `eq-freq` take `bins`, `manual` takes `edges`."""
    if how == "eq-width":
        return equal_width(df, column, bins, **options)
    if how == "eq-freq":
        return equal_frequency(df, column, bins, **options)
    if how == "manual":
        return manual_bins(df, column, edges, **options)
    raise ValueError(f"unknown method {how!r}; choose eq-width, eq-freq or manual")

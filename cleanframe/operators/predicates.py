"""Row removal by predicate list, outlier limits, search and NULL selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import TEXT, data_type, friendly_type, ref, require, typed_literal

# Comparison operators of a predicate with their negations, and its connectors.
COMPARISONS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
NEGATIONS = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}
CONNECTORS = ("AND", "OR")


def like_anywhere(text: Column, part: str, wildcards: bool = True) -> Column:
    """`part` occurs in `text`; with `wildcards`, % and _ inside `part` match as in LIKE."""
    return text.like(f"%{part}%") if wildcards else text.contains(F.lit(part))


def comparison(df: DataFrame, column: str, op: str, value, wildcards: bool = True) -> Column:
    dtype = data_type(df, column)
    if op == "CONTAINS":
        return like_anywhere(ref(column).cast("string"), str(value), wildcards)
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; choose one of {', '.join(COMPARISONS)}, CONTAINS")
    return COMPARISONS[op](ref(column), typed_literal(value, dtype))


def not_true(df: DataFrame, column: str, op: str, value, wildcards: bool = True) -> Column:
    """The comparison is false or NULL, in a form that can be pushed into a scan."""
    test = comparison(df, column, op, value, wildcards)
    if op == "CONTAINS":
        return ~test | ref(column).isNull()
    unknown = ref(column).isNull() if value is not None else F.lit(True)
    return comparison(df, column, NEGATIONS[op], value) | unknown


def any_of_all(df: DataFrame, predicates: list[tuple]) -> list[list[tuple]]:
    """[(connector, column, op, value), ...] as an OR of ANDs: AND binds first, the first connector is ignored."""
    if not predicates:
        raise ValueError("no predicate given")
    groups: list[list[tuple]] = []
    for i, (connector, *test) in enumerate(predicates):
        if i and connector not in CONNECTORS:
            raise ValueError(f"unknown connector {connector!r}; choose AND or OR")
        if i and connector == "AND":
            groups[-1].append(tuple(test))
        else:
            groups.append([tuple(test)])
    return groups


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def predicate(df: DataFrame, predicates: list[tuple], wildcards: bool = True) -> Column:
    """The predicate list as one condition."""
    return _any(_all(comparison(df, *t, wildcards) for t in group) for group in any_of_all(df, predicates))


def select_where(df: DataFrame, predicates: list[tuple], wildcards: bool = True) -> DataFrame:
    return df.where(predicate(df, predicates, wildcards))


def remove_where(df: DataFrame, predicates: list[tuple], wildcards: bool = True) -> DataFrame:
    """Drop rows for which the predicate list is true; rows where it is NULL stay."""
    return df.where(_all(_any(not_true(df, *t, wildcards) for t in group) for group in any_of_all(df, predicates)))


def remove_outliers(df: DataFrame, column: str, value, less_than: bool = False) -> DataFrame:
    """Drop rows strictly below (`less_than`) or strictly above `value`; NULLs stay."""
    return remove_where(df, [("", column, "<" if less_than else ">", value)])


def search(df: DataFrame, text: str | None, id_col: str = "id") -> DataFrame:
    """Rows where any column but the id, as text, contains `text`."""
    return df.where(matches(df, text, id_col)) if text else df


def matches(df: DataFrame, text: str, id_col: str = "id") -> Column:
    """Whether any column but the id, as text, contains `text`."""
    tests = [F.coalesce(like_anywhere(ref(c).cast("string"), text), F.lit(False)) for c in df.columns if c != id_col]
    return _any(tests) if tests else F.lit(False)


def nulls_of(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.where(ref(column).isNull())


def non_nulls_of(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.where(ref(column).isNotNull())


def is_text(df: DataFrame, column: str) -> bool:
    return friendly_type(data_type(df, column)) == TEXT

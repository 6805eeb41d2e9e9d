"""Sorting, paging and the grid query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref, require
from cleanframe.operators.predicates import matches, search
from cleanframe.plans.ordering import with_position

SHALLOW_ROWS = 100_000


def order_rows(df: DataFrame, column: str | None, ascending: bool = True, id_col: str = "id") -> DataFrame:
    """NULLs last ascending, first descending; the id breaks ties in the same direction."""
    keys = [id_col] if column in (None, id_col) else [column, id_col]
    require(df, *keys)
    return df.orderBy(*[ref(k).asc_nulls_last() if ascending else ref(k).desc_nulls_first() for k in keys])


def page(df: DataFrame, offset: int = 0, limit: int | None = None, column: str | None = None,
         ascending: bool = True, id_col: str = "id") -> DataFrame:
    """Rows [offset, offset + limit) of the order.

    A shallow page is a top-k, which keeps offset + limit rows per task. A deep one is cut out by global
    position, so that no task or driver holds the skipped rows.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    ordered = order_rows(df, column, ascending, id_col)
    if limit is None and offset == 0:
        return ordered
    if limit is not None and offset + limit <= SHALLOW_ROWS:
        return ordered.offset(offset).limit(limit)
    keys = [id_col] if column in (None, id_col) else [column, id_col]
    placed = with_position(df, keys, "_position")
    if not ascending:
        placed = placed.withColumn("_position", F.lit(df.count() - 1) - F.col("_position"))
    wanted = F.col("_position") >= offset
    if limit is not None:
        wanted &= F.col("_position") < offset + limit
    return placed.where(wanted).orderBy("_position").drop("_position")


def grid(df: DataFrame, offset: int = 0, limit: int | None = None, column: str | None = None, ascending: bool = True,
         text: str | None = None, id_col: str = "id") -> tuple[DataFrame, int, int]:
    """(page of the matching rows, rows in the table, rows matching the search)."""
    matching = search(df, text, id_col)
    if text:
        total, found = df.agg(F.count("*"), F.count_if(matches(df, text, id_col))).first()
    else:
        total = found = df.count()
    return page(matching, offset, limit, column, ascending, id_col), total, found

"""Rows that equal another row in every column but the id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref, require


def remove_identical_rows(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the smallest id of identical rows. NULL equals nothing, so a row with a NULL always stays.

    One hash aggregate: a row with a NULL is grouped by its id as well.
    """
    require(df, id_col)
    values = [c for c in df.columns if c != id_col]
    if not values:
        return df
    has_null = reduce(lambda a, b: a | b, [ref(c).isNull() for c in values])
    grouped = df.groupBy(*[ref(c) for c in values], F.when(has_null, ref(id_col)).alias("_alone"))
    kept = grouped.agg(F.min(ref(id_col)).alias("_kept"))
    return kept.select(*[F.col("_kept").alias(c) if c == id_col else ref(c) for c in df.columns])

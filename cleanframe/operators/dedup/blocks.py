"""Candidate blocks: rows whose cleaned sorting keys are equal or neighbours in key order.

The candidate pairs are never written out. A block is a rank, and two rows are candidates when their ranks
differ by at most one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import NUMERIC, TEXT, TIMESTAMP, kind, ref, require
from cleanframe.functions.text import clean_text
from cleanframe.plans.ordering import with_position
from cleanframe.plans.skew import spread_lookup
from cleanframe.plans.storage import stored

PAIR_COUNT = T.DecimalType(38, 0)

EXACT, NUMBER, DATE, TEXTUAL = "exact", "number", "date", "text"


@dataclass(frozen=True)
class Dimension:
    """One compared column besides the sorting key."""
    column: str
    how: str

    @property
    def least_level(self) -> float:
        """Lowest similarity above 0."""
        return {EXACT: 1.0, TEXTUAL: 1.0, DATE: 0.5, NUMBER: 0.0}[self.how]


def dimensions(df: DataFrame, key: str, exact: list[str], similar: list[str]) -> list[Dimension]:
    """The compared columns. The key is always compared exactly; similar columns of other types are skipped."""
    require(df, key, *exact, *similar)
    found = [Dimension(c, EXACT) for c in dict.fromkeys(exact) if c != key]
    for c in dict.fromkeys(similar):
        how = {TEXT: TEXTUAL, TIMESTAMP: DATE, **dict.fromkeys(NUMERIC, NUMBER)}.get(kind(df, c))
        if how:
            found.append(Dimension(c, how))
    return found


def comparable(df: DataFrame, column: str) -> Column:
    """Text cleaned, NaN as NULL."""
    if kind(df, column) == TEXT:
        return clean_text(ref(column))
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(ref(column)), ref(column))
    return ref(column)


def rank_rows(df: DataFrame, id_col: str, key: str, dims: list[Dimension]) -> DataFrame:
    """(_id, _rank, v0, v1, ...): rank of the row's key among the distinct keys, and its values to compare.

    Rows without a key are in no block and are left out. An empty text matches nothing, like a missing one.
    """
    require(df, id_col)
    values = [comparable(df, d.column) for d in dims]
    values = [F.when(v != "", v) if d.how == TEXTUAL else v for d, v in zip(dims, values)]
    rows = stored(df.select(ref(id_col).alias("_id"), comparable(df, key).alias("_key"),
                            *[v.alias(f"v{i}") for i, v in enumerate(values)]).where(F.col("_key").isNotNull()))
    keys = with_position(stored(rows.select("_key").distinct()), ["_key"], "_rank")
    return spread_lookup(rows, keys, ["_key"]).drop("_key")


def block_sizes(df: DataFrame, key: str) -> DataFrame:
    """(rank, key, n_rows, pairs_inside, pairs_with_next): the size of the candidate set, block by block."""
    require(df, key)
    counted = (df.select(comparable(df, key).alias("key")).where(F.col("key").isNotNull())
               .groupBy("key").agg(F.count("*").alias("n_rows")))
    blocks = with_position(stored(counted), ["key"], "rank")
    following = blocks.select((F.col("rank") - 1).alias("rank"), F.col("n_rows").alias("_next"))
    n, after = F.col("n_rows").cast("decimal(19,0)"), F.coalesce("_next", F.lit(0)).cast("decimal(19,0)")
    return blocks.join(following, "rank", "left").select(
        "rank", "key", "n_rows",
        (n * (n - 1) / 2).cast(PAIR_COUNT).alias("pairs_inside"), (n * after).cast(PAIR_COUNT).alias("pairs_with_next"))

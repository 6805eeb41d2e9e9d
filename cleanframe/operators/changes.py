"""Row-level change sets between two states of a table, and undoing them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import ref, require


class ChangeSet(NamedTuple):
    """`changes` (id, change, column, old, new) with values as text, and the schema to go back to."""
    changes: DataFrame
    schema: T.StructType
    id_col: str


def diff(before: DataFrame, after: DataFrame, id_col: str = "id") -> ChangeSet:
    """Rows updated, deleted and inserted, one change per cell. Deleted and inserted rows list every cell.

    A column present on one side only counts as NULL on the other.
    """
    require(before, id_col)
    require(after, id_col)
    columns = list(dict.fromkeys(before.columns + after.columns))

    def typed(df: DataFrame, name: str) -> Column:
        return ref(name) if name in df.columns else F.lit(None).cast("string")

    def same_type(name: str) -> bool:
        return name in before.columns and name in after.columns and before.schema[name].dataType == after.schema[name].dataType

    def side(df: DataFrame, prefix: str) -> DataFrame:
        cells = [(typed(df, c) if same_type(c) else typed(df, c).cast("string")).alias(f"{prefix}{i}")
                 for i, c in enumerate(columns)]
        return df.select(ref(id_col).alias("_id"), F.lit(True).alias(f"{prefix}_here"), *cells)

    both = side(before, "o").join(side(after, "n"), "_id", "full")
    change = (F.when(F.col("n_here").isNull(), "delete").when(F.col("o_here").isNull(), "insert").otherwise("update"))
    differs = reduce(lambda a, b: a | b, [~F.col(f"o{i}").eqNullSafe(F.col(f"n{i}")) for i in range(len(columns))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o{i}").cast("string").alias("old"),
                               F.col(f"n{i}").cast("string").alias("new")) for i, c in enumerate(columns)])
    touched = (both.withColumn("change", change).where((F.col("change") != "update") | differs)
               .select(F.col("_id").alias("id"), "change", F.explode(cells).alias("cell")))
    changes = touched.select("id", "change", "cell.*").where(
        (F.col("change") != "update") | ~F.col("old").eqNullSafe(F.col("new")))
    return ChangeSet(changes, before.schema, id_col)


def undo(after: DataFrame, change_set: ChangeSet) -> DataFrame:
    """The state before: inserted rows go, deleted rows come back, updated cells get their old values."""
    changes, schema, id_col = change_set
    per_row = changes.groupBy("id").agg(
        F.first("change").alias("_change"),
        F.map_from_entries(F.collect_list(F.struct("column", "old"))).alias("_old"))
    current = after.select(*[(ref(f.name) if f.name in after.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                             for f in schema.fields])
    joined = current.withColumn("_here", F.lit(True)).join(
        per_row.withColumnRenamed("id", "_id"), ref(id_col) == F.col("_id"), "full")
    old = lambda f: F.col("_old")[F.lit(f.name)].cast(f.dataType)
    touched = lambda f: F.coalesce(F.map_contains_key("_old", F.lit(f.name)), F.lit(False))
    return joined.where(F.coalesce(F.col("_change") != "insert", F.lit(True))).select(*[
        F.when(touched(f), old(f)).otherwise(ref(f.name)).alias(f.name) for f in schema.fields])

"""Inequality joins as equi-joins on value ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import ref
from cleanframe.operators.predicates import COMPARISONS
from cleanframe.plans.ordering import MAX_RANGES, range_index, sample_bounds

LOWEST, HIGHEST = -2**63, 2**63 - 1
#: Pairs in one rectangle of the matrix of left and right ranges, and rows on its side if both tables are large.
RECTANGLE_PAIRS = 100_000_000
SIDE_ROWS = 10_000


def _common_type(left: DataFrame, a: str, right: DataFrame, b: str) -> T.DataType:
    both = F.coalesce(F.lit(None).cast(left.schema[a].dataType), F.lit(None).cast(right.schema[b].dataType))
    return left.sparkSession.range(0).select(both.alias("t")).schema["t"].dataType


def ranges_of_both(left_rows: int, right_rows: int) -> tuple[int, int]:
    """(left ranges, right ranges) whose rectangles hold about RECTANGLE_PAIRS pairs: squares of SIDE_ROWS rows, or long ones where one
    table has fewer rows than that."""
    def ranges(rows: int, others: int) -> int:
        side = max(SIDE_ROWS, RECTANGLE_PAIRS // max(1, others))
        return max(1, min(MAX_RANGES, math.ceil(rows / side)))

    return ranges(left_rows, right_rows), ranges(right_rows, left_rows)


def inequality_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str) -> DataFrame:
    """Inner join on `left.a op right.b` with op one of < <= > >= <>; column names must not overlap.

    Both tables are divided into ranges of (value, row hash), so that one frequent value spans several ranges. A pair of ranges is a
    rectangle of the matrix of all pairs, and a task's work. Their numbers follow from the rows of both tables, so that rectangles hold
    about equally many pairs. A row goes to just those rectangles of its range that can hold a partner of its value; all pairs met
    apart from those in rectangles on the border are result rows.
    """
    if op == "<>":
        return inequality_join(left, right, a, "<", b).unionByName(inequality_join(left, right, a, ">", b))
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"not an inequality: {op!r}")
    common = _common_type(left, a, right, b)

    def key(value: Column, tie: Column) -> Column:
        return F.struct(value.cast(common).alias("v"), tie.cast("long").alias("h"))

    left, right = left.where(ref(a).isNotNull()), right.where(ref(b).isNotNull())
    left_rows, right_rows = left.count(), right.count()
    left_ranges, right_ranges = ranges_of_both(left_rows, right_rows)
    left_key, right_key = (key(ref(c), F.xxhash64(*[ref(x) for x in df.columns])) for df, c in ((left, a), (right, b)))
    left_bounds, left_type = sample_bounds(left, left_key, left_ranges, left_rows)
    right_bounds, right_type = sample_bounds(right, right_key, right_ranges, right_rows)

    def reached(value: Column, tie: int, upwards: bool, bounds: list, dtype: T.DataType) -> Column:
        at = range_index(key(value, F.lit(tie)), bounds, dtype)
        return F.explode(F.sequence(at, F.lit(len(bounds))) if upwards else F.sequence(F.lit(0), at))

    # A row's partners lie beyond its value, and at it where equality counts.
    smaller_left, strict = op in ("<", "<="), op in ("<", ">")
    up, down = (HIGHEST, LOWEST) if strict else (LOWEST, HIGHEST)
    left_side = (left.withColumn("_left", range_index(left_key, left_bounds, left_type))
                 .withColumn("_right", reached(ref(a), up if smaller_left else down, smaller_left, right_bounds, right_type)))
    right_side = (right.withColumn("_right", range_index(right_key, right_bounds, right_type))
                  .withColumn("_left", reached(ref(b), down if smaller_left else up, not smaller_left, left_bounds, left_type)))
    if not left_bounds and not right_bounds:
        # One rectangle: a constant key would make the planner form all pairs and compare them afterwards.
        left_side = left_side.withColumn("_left", F.pmod(left_key["h"], F.lit(2)).cast("int"))
        right_side = right_side.withColumn("_left", F.explode(F.sequence(F.lit(0), F.lit(1))))
    rectangles = (len(left_bounds) + 1) * (len(right_bounds) + 1)
    if rectangles > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left_side, right_side = (df.repartition(min(rectangles, MAX_RANGES), "_left", "_right") for df in (left_side, right_side))
    return (left_side.join(right_side, ["_left", "_right"]).where(COMPARISONS[op](ref(a), ref(b)))
            .drop("_left", "_right"))

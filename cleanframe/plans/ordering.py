"""Global positions and exact order statistics without a single-task sort.

Rows are split into ranges by a bounded list of boundaries. The boundaries come from a sample, which decides
only how even the ranges are, never the result. Each range is sorted by its own task, and the driver holds one
row count per range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import bisect, ref, typed_literal

ROWS_PER_RANGE = 200_000
MAX_RANGES = 8192
SAMPLES_PER_RANGE = 20
RANK_RANGES = 64


def key_struct(columns: list[str], tie: Column | None = None) -> Column:
    """Sort key with NULLs last, comparable as one value."""
    parts = []
    for i, name in enumerate(columns):
        parts += [ref(name).isNull().alias(f"n{i}"), ref(name).alias(f"k{i}")]
    return F.struct(*parts) if tie is None else F.struct(*parts, tie.alias("tie"))


def range_count(total: int) -> int:
    return max(1, min(MAX_RANGES, math.ceil(total / ROWS_PER_RANGE)))


def sample_bounds(df: DataFrame, key: Column, ranges: int, total: int) -> tuple[list, T.DataType]:
    """At most `ranges - 1` ascending, distinct boundaries from a sample whose size depends on `ranges` only."""
    keyed = df.select(key.alias("_k"))
    dtype = keyed.schema["_k"].dataType
    if ranges <= 1 or total == 0:
        return [], dtype
    wanted = ranges * SAMPLES_PER_RANGE
    if total > wanted:
        keyed = keyed.sample(fraction=min(1.0, wanted / total), seed=7)
    sample = [r["_k"] for r in keyed.orderBy("_k").collect()]
    picks = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    return [b for i, b in enumerate(picks) if i == 0 or b != picks[i - 1]], dtype


def range_index(key: Column, bounds: list, dtype: T.DataType) -> Column:
    """Number of boundaries at or below `key`."""
    return bisect([typed_literal(b, dtype) for b in bounds], lambda b: b <= key)


def with_position(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Add a dense LONG position in ascending order of `order_by` (NULLs last), counted from `start`.

    The keys should identify a row; rows equal on all keys get their positions in any order. `df` is read up to
    four times, all but the last time for its keys only: store it first if it is not a plain scan.
    """
    total = df.count()
    ranges, key = range_count(total), key_struct(order_by)
    bounds, dtype = sample_bounds(df, key, ranges, total)
    if len(bounds) < ranges - 1:
        # A key that fills whole ranges: a hash of the row spreads its rows over them.
        key = key_struct(order_by, F.xxhash64(*[ref(c) for c in df.columns]))
        bounds, dtype = sample_bounds(df, key, ranges, total)
    ranged = df.withColumn("_range", range_index(key, bounds, dtype))
    sizes = {0: total}
    if bounds:
        sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    offsets, seen = [], start
    for i in range(len(bounds) + 1):
        offsets.append(seen)
        seen += sizes.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_range") + 1)
    window = Window.partitionBy("_range").orderBy(key)
    return ranged.withColumn(name, F.row_number().over(window) - 1 + offset).drop("_range")


def values_at_ranks(df: DataFrame, column: str, ranks) -> tuple[int, list]:
    """(number of non-NULL values, the values found at the given zero-based ranks of the ascending order).

    `ranks` is a function from that number to a short list of ranks. Only the ranges holding a wanted rank
    are shuffled, as (value, count) pairs.
    """
    values = df.select(ref(column).alias("_v")).where(F.col("_v").isNotNull())
    total = values.count()
    wanted = sorted(set(ranks(total))) if total else []
    if not wanted:
        return total, []
    ranges = max(range_count(total), min(RANK_RANGES, total // SAMPLES_PER_RANGE))
    bounds, dtype = sample_bounds(values, F.col("_v"), ranges, total)
    ranged = values.withColumn("_range", range_index(F.col("_v"), bounds, dtype))
    sizes = {0: total}
    if bounds:
        sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    local_ranks, seen = [], 0
    for i in range(len(bounds) + 1):
        inside = [r - seen for r in wanted if seen <= r < seen + sizes.get(i, 0)]
        local_ranks += [(i, r, r + seen) for r in inside]
        seen += sizes.get(i, 0)
    needed = sorted({i for i, _, _ in local_ranks})
    running = F.sum("_n").over(Window.partitionBy("_range").orderBy("_v"))
    counted = (ranged.where(F.col("_range").isin(needed)).groupBy("_range", "_v").agg(F.count("*").alias("_n"))
               .withColumn("_end", running))
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).cast("long").alias("r"), F.lit(g).cast("long").alias("g"))
                        for i, r, g in local_ranks])
    hits = F.filter(targets, lambda t: (t["i"] == F.col("_range")) & (t["r"] < F.col("_end"))
                    & (t["r"] >= F.col("_end") - F.col("_n")))
    found = counted.select("_v", F.explode(hits).alias("_hit")).select("_v", "_hit.g").collect()
    by_rank = {r["g"]: r["_v"] for r in found}
    return total, [by_rank[r] for r in wanted]

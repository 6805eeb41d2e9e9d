"""Comparison vectors of all candidate pairs, counted without writing the pairs out.

Rows with equal compared values are one tuple with a count. For every subset of the compared columns, tuples
are grouped by their values in it; joining each group to the groups with similar values counts the pairs that
agree on at least this subset. Inclusion-exclusion over the subsets turns that into the number of pairs per
vector. The work depends on the number of groups and of similar values, not on the number of pairs: a block
with a third of all rows costs no more than its distinct values do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.similarity import number_level
from cleanframe.operators.dedup.blocks import DATE, EXACT, NUMBER, PAIR_COUNT, TEXTUAL, Dimension
from cleanframe.operators.dedup.neighbours import date_neighbours, number_bucket, text_neighbours
from cleanframe.plans.skew import all_salts, spread_lookup
from cleanframe.plans.storage import cut_lineage

NEIGHBOURS = {DATE: date_neighbours, TEXTUAL: text_neighbours}
MAX_DIMENSIONS = 12
NUMBER_SALTS = 8


def value_columns(dims: list[Dimension]) -> list[str]:
    return [f"v{i}" for i in range(len(dims))]


def level_columns(dims: list[Dimension]) -> list[str]:
    return [f"l{i}" for i in range(len(dims))]


def tuples_of(rows: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(_rank, v..., _n, _rep): rows equal in block and compared values, how many, and their smallest id."""
    return rows.groupBy("_rank", *value_columns(dims)).agg(F.count("*").alias("_n"), F.min("_id").alias("_rep"))


def has(subset: Column, i: int) -> Column:
    return subset.bitwiseAND(F.lit(1 << i)) != 0


def subsets_of(tuples: DataFrame, dims: list[Dimension], keep: list[int] | None = None) -> DataFrame:
    """Each tuple once per subset of its non-NULL columns (a bit mask `_set`), the other columns set to NULL."""
    if len(dims) > MAX_DIMENSIONS:
        raise ValueError(f"at most {MAX_DIMENSIONS} columns can be compared besides the key")
    present = reduce(lambda a, b: a + b, [F.when(F.col(v).isNotNull(), 1 << i).otherwise(0)
                                          for i, v in enumerate(value_columns(dims))], F.lit(0))
    candidates = F.array(*[F.lit(s) for s in (range(1 << len(dims)) if keep is None else keep)])
    held = F.filter(candidates, lambda s: s.bitwiseAND(F.col("_present")) == s)
    spread = tuples.withColumn("_present", present).withColumn("_set", F.explode(held)).drop("_present")
    for i, v in enumerate(value_columns(dims)):
        spread = spread.withColumn(v, F.when(has(F.col("_set"), i), F.col(v)))
    return spread


def groups_of(spread: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(_rank, _set, v..., _n, _rep) per distinct subset value."""
    return (spread.groupBy("_rank", "_set", *value_columns(dims))
            .agg(F.sum("_n").alias("_n"), F.min("_rep").alias("_rep")))


def _struct_key(rank: str, parts: list[Column]) -> Column:
    return F.struct(F.col(rank).alias("r"), F.col("_set").alias("s"), *[p.alias(f"k{i}") for i, p in enumerate(parts)])


def group_key(dims: list[Dimension]) -> Column:
    """One value that identifies a group."""
    return _struct_key("_rank", [F.col(v) for v in value_columns(dims)])


def sides(groups: DataFrame, tuples: DataFrame, dims: list[Dimension]) -> tuple[DataFrame, DataFrame]:
    """(groups beside the discrete values that similar groups of their block or the next have, groups as those found).

    The first has (_rank_b, _set, same, l..., b..., v..., _own, _n, _rep) with b and l for all columns but numbers, the second
    (_rank, _set, v..., _other, _n_other, _rep_other). Columns compared exactly, by text or by date lead to the other group's values by
    equality or through the list of similar values.
    """
    groups = cut_lineage(groups)
    around = out = groups.withColumn("_rank_b", F.explode(F.array(F.col("_rank"), F.col("_rank") + 1)))
    for i, d in enumerate(dims):
        if d.how == EXACT:
            out = out.withColumn(f"b{i}", F.col(f"v{i}")).withColumn(f"l{i}", has(F.col("_set"), i).cast("double"))
        elif d.how != NUMBER:
            distinct = tuples.select("_rank", F.col(f"v{i}").alias("v")).where("v IS NOT NULL").distinct()
            near = NEIGHBOURS[d.how](distinct).select(
                "_rank", F.col("v").alias(f"v{i}"), "_rank_b", F.col("b").alias(f"b{i}"), F.col("level").alias(f"l{i}"))
            out = spread_lookup(out, near, ["_rank", f"v{i}", "_rank_b"], "left", counted=around)
            out = out.where(~has(F.col("_set"), i) | F.col(f"l{i}").isNotNull()).fillna(0.0, [f"l{i}"])
    asking = out.withColumn("_own", group_key(dims)).withColumn("same", (F.col("_rank") == F.col("_rank_b")).cast("double"))
    asked = groups.select("_rank", "_set", *value_columns(dims), group_key(dims).alias("_other"), F.col("_n").alias("_n_other"),
                          F.col("_rep").alias("_rep_other"))
    return asking, asked


def similar_groups(groups: DataFrame, tuples: DataFrame, dims: list[Dimension]) -> DataFrame:
    """Each group beside every similar group of its block or the next:
    (_set, same, l0, l1, ..., _own, _n, _rep, _other, _n_other, _rep_other).

    Numbers lead to the bucket of the other group and its two neighbours; groups compared by number are salted, since a bucket may hold
    many values.
    """
    values = value_columns(dims)
    numbers = [i for i, d in enumerate(dims) if d.how == NUMBER]
    by_number = reduce(lambda a, b: a | b, [has(F.col("_set"), i) for i in numbers], F.lit(False))
    no_salt = F.lit(0).cast("long")
    asking, asked = sides(groups, tuples, dims)
    for i in numbers:
        bucket = number_bucket(F.col(f"v{i}"))
        reach = F.array(*[bucket + step for step in (-1, 0, 1)])
        asking = asking.withColumn(f"b{i}", F.explode(F.when(has(F.col("_set"), i), reach).otherwise(F.array(bucket))))
    salt = F.pmod(F.xxhash64("_own"), F.lit(NUMBER_SALTS).cast("long"))
    sources = asking.select(
        _struct_key("_rank_b", [F.col(f"b{i}") for i in range(len(dims))]).alias("_key"),
        F.when(by_number, salt).otherwise(no_salt).alias("_salt"), "_set", "_own", "_n", "_rep", "same",
        *[F.col(f"l{i}") for i in range(len(dims)) if i not in numbers], *[F.col(f"v{i}") for i in numbers])
    targets = asked.select(
        _struct_key("_rank", [number_bucket(F.col(v)) if i in numbers else F.col(v) for i, v in enumerate(values)]).alias("_key"),
        F.explode(F.when(by_number, all_salts(NUMBER_SALTS)).otherwise(F.array(no_salt))).alias("_salt"),
        "_other", "_n_other", "_rep_other", *[F.col(f"v{i}").alias(f"w{i}") for i in numbers])
    pairs = sources.join(targets, ["_key", "_salt"])
    for i in numbers:
        level = F.when(has(F.col("_set"), i), number_level(F.col(f"v{i}"), F.col(f"w{i}"))).otherwise(0.0)
        pairs = pairs.withColumn(f"l{i}", level).where(~has(F.col("_set"), i) | (F.col(f"l{i}") > 0))
    return pairs.select("_set", "same", *level_columns(dims), "_own", "_n", "_rep", "_other", "_n_other", "_rep_other")


def agreeing_pairs(similar: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(same, l..., _pairs): twice the number of pairs that agree on at least a subset of the columns, per levels in it."""
    levels = level_columns(dims)
    # Groups of one subset share no row, so equal smallest ids mean the same group. Counting equal sizes first
    # leaves the wide decimals to few rows.
    sized = (similar.withColumn("_self", F.col("_rep") == F.col("_rep_other"))
             .groupBy("same", *levels, "_n", "_n_other", "_self").agg(F.count("*").alias("_times")))
    n, m, times = [F.col(c).cast("decimal(19,0)") for c in ("_n", "_n_other", "_times")]
    ordered = (n * m - F.when(F.col("_self"), m).otherwise(F.lit(0).cast("decimal(19,0)"))).cast(PAIR_COUNT)
    # Inside a block each pair is met from both sides, so pairs between blocks count twice as well until the end.
    twice = (F.when(F.col("same") == 1, ordered).otherwise(2 * ordered) * times).cast(PAIR_COUNT)
    return sized.groupBy("same", *levels).agg(F.sum(twice).cast(PAIR_COUNT).alias("_pairs"))


def vector_counts(tuples: DataFrame, dims: list[Dimension]) -> DataFrame:
    """(same, l0, l1, ..., pairs): the number of candidate pairs per comparison vector; `same` is the key's part."""
    levels = level_columns(dims)
    similar = similar_groups(groups_of(subsets_of(tuples, dims), dims), tuples, dims)
    agreeing = agreeing_pairs(similar, dims)
    signed = agreeing.withColumn("_sign", F.lit(1))
    for level in levels:
        keep = F.struct(F.col(level).alias("l"), F.lit(1).alias("s"))
        clear = F.struct(F.lit(0.0).alias("l"), F.lit(-1).alias("s"))
        signed = signed.withColumn("_o", F.explode(F.when(F.col(level) > 0, F.array(keep, clear))
                                                   .otherwise(F.array(keep))))
        signed = signed.withColumn(level, F.col("_o.l")).withColumn("_sign", F.col("_sign") * F.col("_o.s")).drop("_o")
    total = F.sum(F.when(F.col("_sign") > 0, F.col("_pairs")).otherwise(-F.col("_pairs")))
    return (signed.groupBy("same", *levels).agg((total / 2).cast(PAIR_COUNT).alias("pairs")).where("pairs > 0"))

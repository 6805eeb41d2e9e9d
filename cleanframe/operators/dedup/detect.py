"""Near-duplicate detection: blocks, comparison vectors, classification, clusters."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import ref
from cleanframe.functions.similarity import date_level, exact_level, number_level, text_level
from cleanframe.operators.dedup.blocks import DATE, EXACT, NUMBER, PAIR_COUNT, TEXTUAL, Dimension, dimensions, rank_rows
from cleanframe.operators.dedup.classify import TIE, Rule, classify, two_means
from cleanframe.operators.dedup.components import connected_components
from cleanframe.operators.dedup.exact import remove_identical_rows
from cleanframe.operators.dedup.sweep import Summary, near_links, only_number
from cleanframe.operators.dedup.vectors import (group_key, groups_of, has, level_columns, similar_groups, subsets_of,
                                                tuples_of, value_columns, vector_counts)
from cleanframe.plans.ordering import with_position
from cleanframe.plans.skew import spread_lookup
from cleanframe.plans.storage import cut_lineage, stored

LEVELS = {EXACT: exact_level, NUMBER: number_level, DATE: date_level, TEXTUAL: text_level}


class Duplicates(NamedTuple):
    """`rows` without identical copies, and `clusters` (id, group_id from 1 on, delete = false)."""
    rows: DataFrame
    clusters: DataFrame

    def found(self) -> bool:
        return not self.clusters.isEmpty()


def pair_vectors(df: DataFrame, key: str, exact: list[str], similar: list[str], id_col: str = "id") -> DataFrame:
    """(key, one column per compared column, pairs): how many candidate pairs have which similarities."""
    dims = dimensions(df, key, exact, similar)
    counted = vector_counts(cut_lineage(tuples_of(rank_rows(df, id_col, key, dims), dims)), dims)
    return counted.select(F.col("same").alias(key), *[
        F.col(level).alias(d.column) for level, d in zip(level_columns(dims), dims)], "pairs")


def pair_summary(df: DataFrame, key: str, exact: list[str], similar: list[str], id_col: str = "id") -> DataFrame:
    """(key, one column per compared column but the number, pairs, near, level_sum, level_squares): the candidate pairs per similarity of
    these columns, how many have near numbers, and the sum and sum of squares of their similarity. One of the columns compared must be a
    number. Work grows with the values, not with the pairs."""
    dims = dimensions(df, key, exact, similar)
    number = only_number(dims)
    if number is None:
        raise ValueError("just one of the compared columns must be a number")
    found = Summary(cut_lineage(tuples_of(rank_rows(df, id_col, key, dims), dims)), dims)
    names = [key, *[d.column for i, d in enumerate(dims) if i != number]]
    fields = [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("pairs", PAIR_COUNT), T.StructField("near", PAIR_COUNT),
                                                                  T.StructField("level_sum", T.DoubleType()), T.StructField("level_squares", T.DoubleType())]
    return df.sparkSession.createDataFrame([(*v, Decimal(n), Decimal(m), s, q) for v, n, m, s, q in found.rows()], T.StructType(fields))


def _against(rule: Rule) -> float:
    """What the columns that speak against a match can take off a score at most."""
    return sum(w for w in rule.weights[1:] if w < 0)


def deciding_subsets(rule: Rule, dims: list[Dimension], undecided: bool) -> list[int]:
    """Subsets of the columns speaking for a match on which similarity can be enough, without those that add nothing.

    A subset adds nothing when one column less is enough already at the lowest similarities, with all other
    columns against it. `undecided` keeps subsets that are enough only if some column speaks not against it.
    """
    same, *weights = rule.weights
    helpful = sum(1 << i for i, w in enumerate(weights) if w > 0)

    def score(subset: int, key_agrees: int, lowest: bool) -> float:
        gained = sum(w * (d.least_level if lowest else 1.0)
                     for i, (w, d) in enumerate(zip(weights, dims)) if subset >> i & 1)
        return same * key_agrees + gained - rule.limit

    def adds(subset: int, key_agrees: int) -> bool:
        smaller = [subset & ~(1 << i) for i in range(len(dims)) if subset >> i & 1]
        best = score(subset, key_agrees, False) + (0 if undecided else _against(rule))
        return best > TIE and not any(score(s, key_agrees, True) + _against(rule) > TIE for s in smaller)

    return [s for s in range(1 << len(dims)) if s & helpful == s and (adds(s, 0) or adds(s, 1))]


def _helpful_score(rule: Rule, dims: list[Dimension]) -> Column:
    """The score of a pair without the columns that speak against a match."""
    same, *weights = rule.weights
    return sum((max(w, 0.0) * F.col(c) for w, c in zip(weights, level_columns(dims))),
               F.col("same") * same - rule.limit)


def has_undecided(vectors: DataFrame, dims: list[Dimension], rule: Rule) -> bool:
    """Does some vector match that would not if the columns against a match all agreed?"""
    matching = classify(vectors, ["same", *level_columns(dims)], rule).where("match")
    return _against(rule) < 0 and not matching.where(_helpful_score(rule, dims) + _against(rule) <= TIE).isEmpty()


def _tie(links: DataFrame, members: DataFrame) -> DataFrame:
    """Edges for links (_own, _rep, _other, _rep_other) between groups whose members all match each other.

    The smallest ids of two linked groups are tied, and each member (src, _group) to the smallest id of one group
    that its own is linked to.
    """
    across = links.select(F.col("_rep").alias("src"), F.col("_rep_other").alias("dst"))
    partners = (links.select(F.col("_own").alias("_group"), F.col("_rep_other").alias("dst"))
                .unionByName(links.select(F.col("_other").alias("_group"), F.col("_rep").alias("dst")))
                .groupBy("_group").agg(F.min("dst").alias("dst")))
    return across.unionByName(spread_lookup(members, partners, ["_group"]).select("src", "dst")).distinct()


def match_edges(tuples: DataFrame, dims: list[Dimension], rule: Rule, undecided: bool = False) -> DataFrame:
    """(src, dst) whose components are those of the graph of all matching pairs.

    Groups of tuples alike on a deciding subset are linked, to themselves or to each other, when their
    similarities are enough whatever the other columns say. With `undecided`, groups for which the columns
    against a match decide are divided by the values of these columns, and the parts are compared.
    """
    spread = subsets_of(tuples, dims, deciding_subsets(rule, dims, undecided))
    groups = groups_of(spread, dims)
    score = _helpful_score(rule, dims)
    ends = ["_own", "_rep", "_other", "_rep_other"]
    number = only_number(dims)
    if number is None or undecided or rule.weights[number + 1] <= 0:
        pairs = similar_groups(groups, tuples, dims)
        links = cut_lineage(pairs.where(score + _against(rule) > TIE).select(*ends))
    else:
        groups, weight = cut_lineage(groups), rule.weights[number + 1]
        others = sum((max(w, 0.0) * F.col(f"l{i}") for i, w in enumerate(rule.weights[1:]) if i != number),
                     F.col("same") * rule.weights[0] - rule.limit + _against(rule))
        plain = similar_groups(groups.where(~has(F.col("_set"), number)), tuples, dims)
        near = near_links(groups, tuples, dims, (F.lit(TIE) - others) / weight)
        links = cut_lineage(plain.where(score + _against(rule) > TIE).select(*ends).unionByName(near))
    # NULLs inside a struct compare as equal, which a column left out of the subset needs.
    members = spread.select(F.col("_rep").alias("src"), group_key(dims).alias("_group"))
    edges = _tie(links, members)
    if not undecided:
        return edges

    doubtful = [i for i, w in enumerate(rule.weights[1:]) if w < 0]
    values = tuples.select("_rank", "_rep", *[F.col(f"v{i}").alias(f"x{i}") for i in doubtful])
    held = spread.join(values, ["_rank", "_rep"])
    part_key = F.struct(group_key(dims).alias("g"), *[F.col(f"x{i}") for i in doubtful])
    parts = cut_lineage(held.withColumn("_group", group_key(dims)).withColumn("_part", part_key)
                        .groupBy("_group", "_part").agg(F.min("_rep").alias("_rep_part")))
    open_pairs = cut_lineage(pairs.where((score > TIE) & (score + _against(rule) <= TIE))
                             .select("_own", "_other", score.alias("_score")))
    compared = (spread_lookup(open_pairs.withColumnRenamed("_own", "_group"), parts, ["_group"])
                .select("_score", F.col("_part").alias("_own"), F.col("_rep_part").alias("_rep"),
                        F.col("_other").alias("_group")))
    compared = (spread_lookup(compared, parts, ["_group"])
                .select("_score", "_own", "_rep", F.col("_part").alias("_other"), F.col("_rep_part").alias("_rep_other")))
    for i in doubtful:
        level = LEVELS[dims[i].how](F.col(f"_own.x{i}"), F.col(f"_other.x{i}"))
        compared = compared.withColumn("_score", F.col("_score") + rule.weights[i + 1] * level)
    links = cut_lineage(compared.where(F.col("_score") > TIE))
    return edges.unionByName(_tie(links, held.select(F.col("_rep").alias("src"), part_key.alias("_group")))).distinct()


def number_clusters(labels: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, group_id, delete) from (id, component): components of two or more rows, numbered from 1 on.

    The cluster table is written out, since a review reads it again and again.
    """
    labels = cut_lineage(labels)
    several = labels.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    numbered = with_position(stored(several), ["component"], "group_id", 1)
    clusters = spread_lookup(labels, numbered, ["component"])
    return cut_lineage(clusters.select(ref(id_col), "group_id", F.lit(False).alias("delete")))


def find_duplicates(df: DataFrame, key: str, exact: list[str] = (), similar: list[str] = (),
                    id_col: str = "id") -> Duplicates:
    """Drop identical rows, then cluster those that match in the same or the next block of the sorting key.

    Two-means on the comparison vectors decides what a match is; matches of matches share a cluster.
    """
    reduced = cut_lineage(remove_identical_rows(df, id_col))
    dims = dimensions(reduced, key, list(exact), list(similar))
    rows = cut_lineage(rank_rows(reduced, id_col, key, dims))
    tuples = cut_lineage(tuples_of(rows, dims))
    if only_number(dims) is None:
        vectors = cut_lineage(vector_counts(tuples, dims))
        rule = two_means(vectors, ["same", *level_columns(dims)])
        undecided = rule is not None and has_undecided(vectors, dims, rule)
    else:
        summary = Summary(tuples, dims)
        rule = summary.two_means()
        undecided = rule is not None and summary.undecided(rule)
    if rule is None:
        nothing = reduced.select(ref(id_col), F.lit(0).cast("long").alias("group_id"), F.lit(False).alias("delete"))
        return Duplicates(reduced, nothing.where(F.lit(False)))
    labels = connected_components(match_edges(tuples, dims, rule, undecided))
    of_tuple = F.struct(F.col("_rank").alias("r"), *[F.col(v) for v in value_columns(dims)])
    component = spread_lookup(tuples.select(of_tuple.alias("_tuple"), F.col("_rep").alias("node")), labels, ["node"])
    labelled = spread_lookup(rows.select(F.col("_id").alias(id_col), of_tuple.alias("_tuple")),
                             component.select("_tuple", "component"), ["_tuple"]).select(ref(id_col), "component")
    return Duplicates(reduced, number_clusters(labelled, id_col))

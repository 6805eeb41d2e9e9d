"""Looking at clusters, marking rows for deletion and closing clusters.

A cluster table has (id, group_id, delete). A cluster is open while it has an unmarked member.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.operators.page import page
from cleanframe.operators.predicates import search
from cleanframe.operators.rows import delete_ids, id_frame
from cleanframe.plans.skew import spread_lookup


class Review(NamedTuple):
    """The rows, their clusters, and whether the review is over (marked rows are then deleted)."""
    rows: DataFrame
    clusters: DataFrame
    finished: bool


def open_clusters(clusters: DataFrame) -> DataFrame:
    """(group_id, n_members): unmarked members per open cluster."""
    return clusters.where(~F.col("delete")).groupBy("group_id").agg(F.count("*").alias("n_members"))


def open_count(clusters: DataFrame) -> int:
    return open_clusters(clusters).count()


def next_group(clusters: DataFrame) -> int | None:
    """Smallest open cluster."""
    return clusters.where(~F.col("delete")).agg(F.min("group_id")).first()[0]


def cluster_rows(rows: DataFrame, clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with the number of their cluster, unmarked members only."""
    members = clusters.where(~F.col("delete")).select(ref(id_col), "group_id")
    return rows.join(members, id_col).select(*[ref(c) for c in rows.columns], "group_id")


def show_cluster(rows: DataFrame, clusters: DataFrame, group_id: int, offset: int = 0, limit: int | None = None,
                 column: str | None = None, ascending: bool = True, text: str | None = None,
                 id_col: str = "id") -> DataFrame:
    """A page of one cluster's members whose text contains `text`."""
    members = cluster_rows(rows, clusters.where(F.col("group_id") == group_id), id_col).drop("group_id")
    return page(search(members, text, id_col), offset, limit, column, ascending, id_col)


def mark_rows(clusters: DataFrame, ids: DataFrame | list, id_col: str = "id") -> DataFrame:
    """Mark members for deletion. A NULL among the ids names no row."""
    if not isinstance(ids, DataFrame):
        ids = id_frame(clusters, ids, id_col)
    marks = ids.select(ref(ids.columns[0]).alias(id_col)).where(ref(id_col).isNotNull()).distinct().withColumn("_mark", F.lit(True))
    return (clusters.join(marks, id_col, "left")
            .withColumn("delete", F.col("delete") | F.coalesce("_mark", F.lit(False)))
            .select(ref(id_col), "group_id", "delete"))


def close_cluster(clusters: DataFrame, group_id: int) -> DataFrame:
    """Drop the unmarked members of a cluster: they are kept in the table."""
    return clusters.where((F.col("group_id") != group_id) | F.col("delete"))


def resolve_rest(clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """In each open cluster keep the smallest unmarked id and mark the others; no cluster stays open."""
    unmarked = clusters.where(~F.col("delete"))
    kept = unmarked.groupBy("group_id").agg(F.min(ref(id_col)).alias("_kept"))
    dropped = (spread_lookup(unmarked, kept, ["group_id"]).where(ref(id_col) != F.col("_kept"))
               .select(ref(id_col), "group_id", F.lit(True).alias("delete")))
    return clusters.where("delete").unionByName(dropped)


def apply_marks(rows: DataFrame, clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """Delete all marked rows."""
    return delete_ids(rows, clusters.where("delete").select(ref(id_col)), id_col)


def _finish(rows: DataFrame, clusters: DataFrame, id_col: str) -> Review:
    return Review(apply_marks(rows, clusters, id_col), clusters.where(F.lit(False)), True)


def _continue(rows: DataFrame, clusters: DataFrame, id_col: str) -> Review:
    return _finish(rows, clusters, id_col) if open_count(clusters) == 0 else Review(rows, clusters, False)


def mark_and_stay(rows: DataFrame, clusters: DataFrame, ids, id_col: str = "id") -> Review:
    return _continue(rows, mark_rows(clusters, ids, id_col), id_col)


def _mark_and_close(clusters: DataFrame, ids, id_col: str) -> DataFrame:
    """The cluster under review is the first open one before the marks are set."""
    current = next_group(clusters)
    marked = mark_rows(clusters, ids, id_col)
    return marked if current is None else close_cluster(marked, current)


def mark_and_next(rows: DataFrame, clusters: DataFrame, ids, id_col: str = "id") -> Review:
    return _continue(rows, _mark_and_close(clusters, ids, id_col), id_col)


def mark_and_finish(rows: DataFrame, clusters: DataFrame, ids, id_col: str = "id") -> Review:
    return _finish(rows, _mark_and_close(clusters, ids, id_col), id_col)


def mark_and_resolve(rows: DataFrame, clusters: DataFrame, ids=(), id_col: str = "id") -> Review:
    """Close the current cluster if something was marked in it, then resolve all others."""
    given = isinstance(ids, DataFrame) or len(ids) > 0
    closed = _mark_and_close(clusters, ids, id_col) if given else clusters
    return _finish(rows, resolve_rest(closed, id_col), id_col)

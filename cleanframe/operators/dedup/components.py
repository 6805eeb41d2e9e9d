"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.plans.skew import spread_lookup
from cleanframe.plans.storage import cut_lineage

MAX_ROUNDS = 100


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang the larger neighbours of each node below its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_lookup(both.where("v > u"), low, ["u"], most_rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang each node and its smaller neighbours below the smallest of them. Edges point to the smaller end."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = (spread_lookup(edges, low, ["u"], most_rows=n).where("v != m")
               .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return smaller.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """(number of edges, are they stars: every node has one parent, and no parent is itself a child)."""
    roles = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("r")).select("r.*")
    counted = roles.groupBy("node").agg(F.sum("child").alias("parents"), F.max("parent").alias("is_parent"))
    unfinished = (F.col("parents") > 1) | ((F.col("parents") == 1) & (F.col("is_parent") == 1))
    row = counted.agg(F.coalesce(F.sum("parents"), F.lit(0)).alias("n"), F.count_if(unfinished).alias("open")).first()
    return row["n"], row["open"] == 0


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the smallest node of each node's component. An edge from a node to itself lists it.

    The number of rounds grows with the logarithm of the size of the largest component. Each round aggregates
    per node before it joins, spreads the edges of a hub over several tasks, and is checkpointed.
    """
    named = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    named = cut_lineage(named.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    nodes = named.select(F.col("u").alias("node")).unionByName(named.select(F.col("v").alias("node"))).distinct()
    stars = named.where("u != v")
    for _ in range(MAX_ROUNDS):
        n, finished = _state(stars)
        if finished:
            break
        # The large star has one row per edge, the first end of a row being its larger one.
        stars = cut_lineage(_small_star(_large_star(stars, n), n))
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    return (nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("_root")), "node", "left")
            .select("node", F.coalesce("_root", "node").alias("component")))

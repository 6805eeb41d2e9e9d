from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with holes in l_quantity."""
    return table(spark, folder, "lineitem").withColumn(
        "l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


def gaps_text(spark: SparkSession, folder: str) -> DataFrame:
    """orders with holes in o_orderpriority."""
    return table(spark, folder, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))


def with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """orders with NaN in o_totalprice."""
    return table(spark, folder, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("o_totalprice"))


WITHOUT_NAN = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)"
GAPS = "(SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity) FROM lineitem)"
GAPS_TEXT = "(SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders)"
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE = ", ".join(LINE_KEYS)

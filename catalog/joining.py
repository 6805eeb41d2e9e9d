"""Joins of many tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from cleanframe.operators.joins import Pair, join_tables


def _with_id(df, key):
    return df.withColumn("id", F.col(key))


@query("join_equi", """
    SELECT row_number() OVER (ORDER BY o_orderkey, c_custkey) AS id, o_orderkey AS orders0_o_orderkey,
        o_custkey AS orders0_o_custkey, o_totalprice AS orders0_o_totalprice, c_custkey AS customer0_c_custkey,
        c_name AS customer0_c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_equi(spark, d):
    tables = {"orders": _with_id(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey"),
              "customer": _with_id(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")}
    return join_tables(tables, [Pair("orders", "o_custkey", "=", "customer", "c_custkey")])


@query("join_chain", """
    SELECT o_orderkey AS orders0_o_orderkey, o_custkey AS orders0_o_custkey, c_custkey AS customer0_c_custkey,
        c_nationkey AS customer0_c_nationkey, n_nationkey AS nation0_n_nationkey, n_name AS nation0_n_name,
        n_regionkey AS nation0_n_regionkey, r_regionkey AS region0_r_regionkey, r_name AS region0_r_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def join_chain(spark, d):
    tables = {"orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"),
              "customer": table(spark, d, "customer").select("c_custkey", "c_nationkey"),
              "nation": table(spark, d, "nation"), "region": table(spark, d, "region")}
    return join_tables(tables, [
        Pair("orders", "o_custkey", "=", "customer", "c_custkey"), Pair("nation", "n_regionkey", "=", "region", "r_regionkey"),
        Pair("customer", "c_nationkey", "=", "nation", "n_nationkey")], id_col=None)


@query("join_self", """
    SELECT a.n_nationkey AS nation0_n_nationkey, a.n_regionkey AS nation0_n_regionkey, a.n_name AS nation0_n_name,
        b.n_nationkey AS nation1_n_nationkey, b.n_regionkey AS nation1_n_regionkey, b.n_name AS nation1_n_name
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey""")
def join_self(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return join_tables({"nation": nation}, [Pair("nation", "n_regionkey", "=", "nation", "n_nationkey")], id_col=None)


@query("join_swapped", """
    SELECT o_orderkey AS orders0_o_orderkey, l_orderkey AS lineitem0_l_orderkey, l_linenumber AS lineitem0_l_linenumber,
        l_suppkey AS lineitem0_l_suppkey, s_suppkey AS supplier0_s_suppkey, s_name AS supplier0_s_name
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey""")
def join_swapped(spark, d):
    tables = {"orders": table(spark, d, "orders").select("o_orderkey"),
              "lineitem": table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"),
              "supplier": table(spark, d, "supplier").select("s_suppkey", "s_name")}
    return join_tables(tables, [Pair("orders", "o_orderkey", "=", "lineitem", "l_orderkey"),
                                Pair("supplier", "s_suppkey", "=", "lineitem", "l_suppkey")], id_col=None)


for _name, _op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "ne": "<>"}.items():
    @query(f"join_theta_{_name}", f"""
        SELECT s_suppkey AS supplier0_s_suppkey, s_nationkey AS supplier0_s_nationkey, n_nationkey AS nation0_n_nationkey,
            n_name AS nation0_n_name FROM supplier JOIN nation ON s_nationkey {_op} n_nationkey""")
    def join_theta(spark, d, op=_op):
        tables = {"supplier": table(spark, d, "supplier").select("s_suppkey", "s_nationkey"),
                  "nation": table(spark, d, "nation").select("n_nationkey", "n_name")}
        return join_tables(tables, [Pair("supplier", "s_nationkey", op, "nation", "n_nationkey")], id_col=None)


@query("join_theta_swapped", """
    SELECT s_suppkey AS supplier0_s_suppkey, s_nationkey AS supplier0_s_nationkey, n_nationkey AS nation0_n_nationkey,
        n_regionkey AS nation0_n_regionkey, r_regionkey AS region0_r_regionkey, r_name AS region0_r_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey >= n_regionkey""")
def join_theta_swapped(spark, d):
    tables = {"supplier": table(spark, d, "supplier").select("s_suppkey", "s_nationkey"),
              "nation": table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "region": table(spark, d, "region")}
    return join_tables(tables, [Pair("supplier", "s_nationkey", "=", "nation", "n_nationkey"),
                                Pair("region", "r_regionkey", ">=", "nation", "n_regionkey")], id_col=None)

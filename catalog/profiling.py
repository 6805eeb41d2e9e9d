"""Profiles, histograms, search and pages, activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPS, GAPS_TEXT, WITHOUT_NAN, gaps, gaps_text, query, table, with_nan
from cleanframe.operators import page, predicates, profile
from cleanframe.streaming import activity

FIGURES = ["column", "type", "average", "minimum", "maximum", "most_common", "n_empty"]


def profile_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        number = kind in ("integer", "double", "real")
        common = (f"(SELECT CAST({name} AS VARCHAR) FROM {source} WHERE {name} IS NOT NULL GROUP BY {name} "
                  f"ORDER BY count(*) DESC, {name} LIMIT 1)")
        figures = [f"round(CAST(coalesce({f}({name}), 0) AS DOUBLE), 6)" if number else "CAST(NULL AS DOUBLE)"
                   for f in ("avg", "min", "max")]
        values = [f"'{name}'", f"'{kind}'", *figures, common, f"count(*) - count({name})"]
        parts.append("SELECT " + ", ".join(f'{v} AS "{a}"' for v, a in zip(values, FIGURES)) + f" FROM {source}")
    return " UNION ALL ".join(parts)


def rounded_profile(df):
    return df.select("column", "type", *[F.round(c, 6).alias(c) for c in ("average", "minimum", "maximum")],
                     "most_common", "n_empty")


@query("profile_table", profile_sql("orders", {
    "o_custkey": "integer", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "timestamp",
    "o_orderpriority": "text"}))
def profile_table(spark, d):
    return rounded_profile(profile.table_profile(table(spark, d, "orders"), id_col="o_orderkey"))


@query("profile_nulls", profile_sql(GAPS_TEXT, {"o_totalprice": "double", "o_orderpriority": "text"}))
def profile_nulls(spark, d):
    return rounded_profile(profile.table_profile(gaps_text(spark, d), ["o_totalprice", "o_orderpriority"]))


@query("profile_column", profile_sql(GAPS, {"l_quantity": "double"}))
def profile_column(spark, d):
    return rounded_profile(profile.column_profile(gaps(spark, d), "l_quantity"))


@query("median_value", f"SELECT round(median(l_quantity), 6) AS median FROM {GAPS}")
def median_value(spark, d):
    df = gaps(spark, d)
    return spark.createDataFrame([(profile.median(df, "l_quantity"),)], "median double")


@query("most_common", """
    SELECT o_custkey AS value, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1""")
def most_common(spark, d):
    return profile.most_common(table(spark, d, "orders"), "o_custkey")


def histogram_sql(source: str, value: str) -> str:
    return f"""
    WITH x AS (SELECT {value} AS v FROM {source}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
    e AS (SELECT CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS edge
          FROM r, generate_series(0, 10) AS s(i)),
    l AS (SELECT list(edge) AS edges FROM e),
    b AS (SELECT len(list_filter(edges, lambda y: y < v)) AS bin FROM x, l)
    SELECT CAST(g.bin AS INTEGER) AS bin, count(b.bin) AS n FROM generate_series(1, 10) AS g(bin)
    LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin"""


@query("histogram_number", histogram_sql("orders", "o_totalprice"))
def histogram_number(spark, d):
    return profile.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "n")


@query("histogram_nan", histogram_sql(WITHOUT_NAN, "o_totalprice"))
def histogram_nan(spark, d):
    return profile.histogram(with_nan(spark, d), "o_totalprice").select("bin", "n")


@query("histogram_timestamp", histogram_sql("events", "CAST(epoch_us(ts) AS DOUBLE)"))
def histogram_timestamp(spark, d):
    return profile.histogram(table(spark, d, "events"), "ts").select("bin", "n")


@query("counts_categorical", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def counts_categorical(spark, d):
    return profile.value_counts(table(spark, d, "events"), "event_type")


@query("distinct_values", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_values(spark, d):
    return profile.distinct_values(table(spark, d, "events"), "user_id", "event_type")


@query("search_any", """
    SELECT * FROM customer WHERE c_name LIKE '%97%' OR CAST(c_nationkey AS VARCHAR) LIKE '%97%'
        OR CAST(c_acctbal AS VARCHAR) LIKE '%97%' OR c_mktsegment LIKE '%97%'""")
def search_any(spark, d):
    return predicates.search(table(spark, d, "customer"), "97", "c_custkey")


@query("page_sorted", "SELECT * FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey DESC LIMIT 50 OFFSET 20")
def page_sorted(spark, d):
    return page.page(table(spark, d, "customer"), 20, 50, "c_acctbal", False, "c_custkey")


@query("page_rest", f"SELECT o_orderkey, o_orderpriority FROM {GAPS_TEXT} ORDER BY o_orderpriority NULLS LAST, o_orderkey OFFSET 700")
def page_rest(spark, d):
    return page.page(gaps_text(spark, d).select("o_orderkey", "o_orderpriority"), 700, None, "o_orderpriority", True, "o_orderkey")


@query("grid_totals", """
    SELECT (SELECT count(*) FROM part) AS total, count(*) AS matching FROM part WHERE p_name LIKE '%an%'
        OR p_brand LIKE '%an%' OR p_type LIKE '%an%' OR CAST(p_size AS VARCHAR) LIKE '%an%' OR CAST(p_retailprice AS VARCHAR) LIKE '%an%'""")
def grid_totals(spark, d):
    _, total, matching = page.grid(table(spark, d, "part"), 10, 25, "p_name", True, "an", "p_partkey")
    return spark.createDataFrame([(total, matching)], "total long, matching long")


@query("page_search", """
    SELECT * FROM part WHERE p_name LIKE '%an%' OR p_brand LIKE '%an%' OR p_type LIKE '%an%'
        OR CAST(p_size AS VARCHAR) LIKE '%an%' OR CAST(p_retailprice AS VARCHAR) LIKE '%an%'
    ORDER BY p_name NULLS LAST, p_partkey LIMIT 25 OFFSET 10""")
def page_search(spark, d):
    shown, _, _ = page.grid(table(spark, d, "part"), 10, 25, "p_name", True, "an", "p_partkey")
    return shown


LATEST = "(SELECT max(ts) FROM events)"


def latest(events):
    return events.agg(F.max("ts")).first()[0]


@query("active_users", f"""
    SELECT event_type, count(DISTINCT user_id) AS n_users FROM events
    WHERE ts >= {LATEST} - INTERVAL 86400 SECONDS AND user_id <> 7 GROUP BY event_type""")
def active_users(spark, d):
    events = table(spark, d, "events")
    return activity.active_users(events, latest(events), "event_type", me=7, timeout=86400)


@query("active_user_list", f"SELECT DISTINCT user_id FROM events WHERE ts >= {LATEST} - INTERVAL 300 SECONDS")
def active_user_list(spark, d):
    events = table(spark, d, "events")
    return activity.active_user_list(events, latest(events))


@query("active_users_rolling", """
    SELECT event_type, date_trunc('minute', ts) - INTERVAL (i) MINUTE AS window_start, count(DISTINCT user_id) AS n_users
    FROM events, generate_series(0, 4) AS g(i) GROUP BY ALL""")
def active_users_rolling(spark, d):
    return activity.rolling_active_users(table(spark, d, "events"), "event_type")

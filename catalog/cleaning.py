"""Schema changes, imputation, replacement, date parts, numbers, row removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPS, GAPS_TEXT, LINE, LINE_KEYS, WITHOUT_NAN, gaps, gaps_text, query, table, with_nan
from cleanframe.operators import dates, encode, impute, numeric, predicates, replace, rows, schema


def _rounded(df, keys, column):
    return df.select(*keys, F.round(F.col(column).cast("double"), 6).alias(column))


# --- schema -----------------------------------------------------------------------------------------------

@query("schema_report", """
    SELECT CAST(column_index AS INTEGER) AS position, column_name AS name, CASE data_type WHEN 'DOUBLE' THEN 'double'
        WHEN 'VARCHAR' THEN 'text' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE 'integer' END AS type
    FROM (SELECT row_number() OVER () - 1 AS column_index, column_name, column_type AS data_type FROM (DESCRIBE orders))""")
def schema_report(spark, d):
    return schema.schema_report(table(spark, d, "orders"))


@query("cast_int", "SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS INTEGER) AS o_totalprice FROM orders")
def cast_int(spark, d):
    return schema.change_type(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "INT")


@query("cast_timestamp", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders")
def cast_timestamp(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return schema.change_type(text, "day", "TIMESTAMP")


@query("cast_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def cast_text(spark, d):
    return schema.change_type(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "VARCHAR(255)")


@query("cast_bit", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber % 2 = 1 AS l_linenumber FROM lineitem")
def cast_bit(spark, d):
    return schema.change_type(table(spark, d, "lineitem").select(*LINE_KEYS), "l_linenumber", "BIT")


@query("rename", 'SELECT c_custkey, c_name AS "full name", c_acctbal FROM customer')
def rename(spark, d):
    return schema.rename_column(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"),
                                "c_name", "full name")


@query("add_drop", "SELECT s_suppkey, s_name, s_acctbal, CAST(NULL AS DOUBLE) AS rating FROM supplier")
def add_drop(spark, d):
    df = schema.add_column(table(spark, d, "supplier"), "rating", "DOUBLE PRECISION")
    return schema.drop_column(schema.add_column(df, "s_name", "INT"), "s_nationkey")


@query("assign_id", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id, o_orderkey FROM orders")
def assign_id(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", "o_orderkey")
    return rows.assign_id(df, ["o_totalprice", "o_orderkey"]).select("id", "o_orderkey")


@query("insert_rows", """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    UNION ALL SELECT max(c_custkey) + 1, 'New One', NULL FROM customer
    UNION ALL SELECT max(c_custkey) + 2, NULL, 'BUILDING' FROM customer""")
def insert_rows(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.insert_rows(df, [{"c_name": "New One", "c_mktsegment": ""}, {"c_mktsegment": "BUILDING"}], "c_custkey")


@query("append_rows", """
    SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_name AS name FROM customer
    UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier""")
def append_rows(spark, d):
    first = rows.assign_id(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")),
                           ["c_custkey"]).drop("c_custkey")
    more = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return rows.append_rows(first, more, ["s_suppkey"])


# --- imputation -------------------------------------------------------------------------------------------

@query("impute_avg", f"""
    SELECT {LINE}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {GAPS})), 6) AS l_quantity FROM {GAPS}""")
def impute_avg(spark, d):
    return _rounded(impute.impute(gaps(spark, d), "l_quantity", "AVG"), LINE_KEYS, "l_quantity")


@query("impute_avg_int", f"""
    WITH g AS (SELECT * REPLACE (CAST(l_quantity AS INTEGER) AS l_quantity) FROM {GAPS})
    SELECT {LINE}, coalesce(l_quantity, CAST(round_even((SELECT avg(l_quantity) FROM g), 0) AS INTEGER)) AS l_quantity
    FROM g""")
def impute_avg_int(spark, d):
    df = gaps(spark, d).withColumn("l_quantity", F.col("l_quantity").cast("int"))
    return impute.impute(df, "l_quantity", "AVG").select(*LINE_KEYS, "l_quantity")


@query("impute_median", f"""
    WITH g AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS l_extendedprice) FROM lineitem)
    SELECT {LINE}, round(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM g)), 6) AS l_extendedprice
    FROM g""")
def impute_median(spark, d):
    df = table(spark, d, "lineitem").withColumn(
        "l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")))
    return _rounded(impute.impute(df, "l_extendedprice", "MEDIAN"), LINE_KEYS, "l_extendedprice")


@query("impute_median_int", """
    WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size FROM part)
    SELECT p_partkey, coalesce(p_size, CAST(round_even((SELECT median(p_size) FROM g), 0) AS INTEGER)) AS p_size
    FROM g""")
def impute_median_int(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"))
    return impute.impute(df, "p_size", "MEDIAN")


@query("impute_mcv", f"""
    SELECT o_orderkey, coalesce(o_orderpriority, (
        SELECT o_orderpriority FROM {GAPS_TEXT} WHERE o_orderpriority IS NOT NULL
        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
    FROM {GAPS_TEXT}""")
def impute_mcv(spark, d):
    return impute.impute(gaps_text(spark, d), "o_orderpriority", "MCV").select("o_orderkey", "o_orderpriority")


@query("impute_custom", f"SELECT o_orderkey, coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM {GAPS_TEXT}")
def impute_custom(spark, d):
    return impute.impute(gaps_text(spark, d), "o_orderpriority", "CUSTOM", "unknown").select("o_orderkey", "o_orderpriority")


# --- replacement ------------------------------------------------------------------------------------------

@query("replace_substring", "SELECT p_partkey, replace(p_name, 'e', 'E-') AS p_name FROM part")
def replace_substring(spark, d):
    return replace.find_replace(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "substring", "e", "E-")


@query("replace_full", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS p_size FROM part")
def replace_full(spark, d):
    return replace.find_replace(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "full replace", "7", "70")


@query("replace_regex_first", r"""
    SELECT doc_id, regexp_replace(text, '([aeiou])([a-z])', '<\2\1>', 's') AS text FROM documents""")
def replace_regex_first(spark, d):
    return replace.find_replace(table(spark, d, "documents").select("doc_id", "text"), "text", "regex",
                                "([aeiou])([a-z])", r"<\2\1>")


@query("replace_regex_all", r"SELECT c_custkey, regexp_replace(c_name, '0(.)', '\1$', 'g') AS c_name FROM customer")
def replace_regex_all(spark, d):
    return replace.find_replace(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "regex",
                                "0(.)", r"\1$", every=True)


def clean_sql(text: str) -> str:
    text = rf"regexp_replace(lower({text}), '(\[.*?\]|\(.*?\)|\{{.*?\}})', '', 'g')"
    text = rf"regexp_replace({text}, '[^ \-_A-Za-z0-9]+', '', 'g')"
    text = rf"regexp_replace({text}, '[\-_]', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '\s\s+', ' ', 'g'))"


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def clean_text(spark, d):
    return replace.clean_column(table(spark, d, "documents").select("doc_id", "text"), "text")


# --- date parts -------------------------------------------------------------------------------------------

for _part, _sql in {
    "DOW": "CAST(dayofweek(ts) AS DOUBLE)", "MONTH": "CAST(month(ts) AS DOUBLE)", "YEAR": "CAST(year(ts) AS DOUBLE)",
    "DATE": "strftime(ts, '%Y-%m-%d')", "TIME": "CAST(CAST(ts AS TIME) AS VARCHAR)",
}.items():
    @query(f"date_{_part.lower()}", f'SELECT event_id, {_sql} AS "ts ({_part})" FROM events')
    def date_part(spark, d, part=_part):
        return dates.extract_part(table(spark, d, "events").select("event_id", "ts"), "ts", part).drop("ts")


# --- numbers ----------------------------------------------------------------------------------------------

@query("normalize", """
    SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
        / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice_norm FROM orders""")
def normalize(spark, d):
    df = numeric.normalize(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return _rounded(df, ["o_orderkey"], "o_totalprice_norm")


@query("normalize_nan", f"""
    SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM {WITHOUT_NAN}))
        / (SELECT stddev_pop(o_totalprice) FROM {WITHOUT_NAN}), 6) AS o_totalprice_norm FROM {WITHOUT_NAN}""")
def normalize_nan(spark, d):
    return _rounded(numeric.normalize(with_nan(spark, d), "o_totalprice"), ["o_orderkey"], "o_totalprice_norm")


@query("bins_width_nan", f"""
    WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {WITHOUT_NAN}),
    e AS (SELECT CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) WHEN i = 7 THEN hi ELSE lo + i * ((hi - lo) / 7) END AS edge
          FROM r, generate_series(0, 7) AS s(i)),
    l AS (SELECT list(edge) AS edges FROM e)
    SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN
        CAST(len(list_filter(edges, lambda x: x < o_totalprice)) AS INTEGER) END AS bin FROM {WITHOUT_NAN}, l""")
def bins_width_nan(spark, d):
    return numeric.discretize(with_nan(spark, d), "o_totalprice", "eq-width", 7, index_name="bin").select("o_orderkey", "bin")


@query("bins_frequency_nan", f"""
    WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n
               FROM {WITHOUT_NAN} WHERE o_totalprice IS NOT NULL),
    l AS (SELECT list(x - x / 1000) AS edges FROM s WHERE r % (n // 6) = 0),
    b AS (SELECT o_orderkey, len(list_filter(edges, lambda x: x < o_totalprice)) AS bin, len(edges) AS n FROM {WITHOUT_NAN}, l)
    SELECT o_orderkey, CAST(CASE WHEN bin BETWEEN 1 AND n - 1 THEN bin END AS INTEGER) AS bin FROM b""")
def bins_frequency_nan(spark, d):
    return numeric.discretize(with_nan(spark, d), "o_totalprice", "eq-freq", 6, index_name="bin").select("o_orderkey", "bin")


@query("normalize_constant", "SELECT o_orderkey, CAST(5 AS DOUBLE) AS five_norm FROM orders")
def normalize_constant(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.lit(5).alias("five"))
    return numeric.normalize(df, "five").drop("five")


@query("bins_width", """
    WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    e AS (SELECT CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) WHEN i = 7 THEN hi ELSE lo + i * ((hi - lo) / 7) END AS edge
          FROM r, generate_series(0, 7) AS s(i)),
    l AS (SELECT list(edge) AS edges FROM e)
    SELECT o_orderkey, CAST(len(list_filter(edges, lambda x: x < o_totalprice)) AS INTEGER) AS bin FROM orders, l""")
def bins_width(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return numeric.discretize(df, "o_totalprice", "eq-width", 7, index_name="bin").select("o_orderkey", "bin")


@query("bins_frequency", """
    WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n
               FROM orders),
    l AS (SELECT list(x - x / 1000) AS edges FROM s WHERE r % (n // 6) = 0),
    b AS (SELECT o_orderkey, len(list_filter(edges, lambda x: x < o_totalprice)) AS bin, len(edges) AS n FROM orders, l)
    SELECT o_orderkey, CAST(CASE WHEN bin BETWEEN 1 AND n - 1 THEN bin END AS INTEGER) AS bin FROM b""")
def bins_frequency(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return numeric.discretize(df, "o_totalprice", "eq-freq", 6, index_name="bin").select("o_orderkey", "bin")


@query("bins_frequency_closed", f"""
    WITH s AS (SELECT l_quantity AS x, row_number() OVER (ORDER BY l_quantity) - 1 AS r, count(*) OVER () AS n
               FROM lineitem),
    l AS (SELECT list(DISTINCT x) AS edges FROM s
          WHERE r = n - 1 OR r IN (SELECT DISTINCT n * i // 4 FROM s, generate_series(0, 3) AS g(i)))
    SELECT {LINE}, CAST(greatest(1, len(list_filter(edges, lambda x: x < l_quantity))) AS INTEGER) AS bin
    FROM lineitem, l""")
def bins_frequency_closed(spark, d):
    df = table(spark, d, "lineitem")
    return numeric.discretize(df, "l_quantity", "eq-freq", 4, mode="quantile", index_name="bin").select(*LINE_KEYS, "bin")


@query("bins_manual", """
    SELECT p_partkey, CASE WHEN p_size > 5 AND p_size <= 10 THEN '(5, 10]' WHEN p_size > 10 AND p_size <= 20 THEN '(10, 20]'
        WHEN p_size > 20 AND p_size <= 45 THEN '(20, 45]' END AS p_size_intervals_custom FROM part""")
def bins_manual(spark, d):
    return numeric.discretize(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "manual",
                              edges="5,10,20,45").drop("p_size")


@query("one_hot", f"""
    SELECT o_orderkey, {', '.join(f"CAST(coalesce(o_orderpriority = '{v}', false) AS INTEGER) AS \"{v}\"" for v in
    ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM {GAPS_TEXT}""")
def one_hot(spark, d):
    return encode.one_hot(gaps_text(spark, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority").drop("o_orderpriority")


# --- row removal ------------------------------------------------------------------------------------------

@query("remove_predicate", f"""
    SELECT {LINE}, l_quantity FROM {GAPS}
    WHERE NOT coalesce(l_quantity >= 25 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-01-01', false)""")
def remove_predicate(spark, d):
    return predicates.remove_where(gaps(spark, d), [
        ("", "l_quantity", ">=", "25"), ("AND", "l_returnflag", "=", "R"),
        ("AND", "l_shipdate", "<", "1995-01-01")]).select(*LINE_KEYS, "l_quantity")


@query("remove_predicate_or", f"""
    SELECT {LINE}, l_quantity FROM {GAPS}
    WHERE NOT coalesce(l_quantity < 10 OR l_linenumber <> 2 AND l_tax <= 0.04 OR l_discount > 0.05, false)""")
def remove_predicate_or(spark, d):
    return predicates.remove_where(gaps(spark, d), [
        ("AND", "l_quantity", "<", "10"), ("OR", "l_linenumber", "<>", "2"), ("AND", "l_tax", "<=", "0.04"),
        ("OR", "l_discount", ">", "0.05")]).select(*LINE_KEYS, "l_quantity")


@query("remove_contains", "SELECT p_partkey, p_name FROM part WHERE NOT p_name LIKE '%re_d%'")
def remove_contains(spark, d):
    return predicates.remove_where(table(spark, d, "part").select("p_partkey", "p_name"), [("", "p_name", "CONTAINS", "re_d")])


@query("outlier_less", f"SELECT {LINE}, l_quantity FROM {GAPS} WHERE l_quantity IS NULL OR l_quantity >= 12")
def outlier_less(spark, d):
    return predicates.remove_outliers(gaps(spark, d), "l_quantity", 12, less_than=True).select(*LINE_KEYS, "l_quantity")


@query("outlier_more", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_totalprice > 300000")
def outlier_more(spark, d):
    return predicates.remove_outliers(table(spark, d, "orders"), "o_totalprice", 300000).select("o_orderkey", "o_totalprice")


@query("select_nulls", f"SELECT {LINE} FROM {GAPS} WHERE l_quantity IS NULL")
def select_nulls(spark, d):
    return predicates.nulls_of(gaps(spark, d), "l_quantity").select(*LINE_KEYS)


@query("delete_ids", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def delete_ids(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity > 48").select("l_orderkey")
    return rows.delete_ids(table(spark, d, "orders"), gone, "o_orderkey")


@query("delete_ids_list", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT n_nationkey * 3 FROM nation)")
def delete_ids_list(spark, d):
    """Ids as a list, a None among them."""
    ids = [r[0] for r in table(spark, d, "nation").select(F.col("n_nationkey") * 3).collect()]
    return rows.delete_ids(table(spark, d, "orders"), [*ids, None], "o_orderkey")


@query("keep_ids", "SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def keep_ids(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity > 48").select("l_orderkey")
    return rows.keep_ids(table(spark, d, "orders"), wanted, "o_orderkey")


@query("select_values", f"SELECT {LINE}, l_quantity FROM {GAPS} WHERE l_quantity IS NOT NULL")
def select_values(spark, d):
    return predicates.non_nulls_of(gaps(spark, d), "l_quantity").select(*LINE_KEYS, "l_quantity")


@query("id_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def id_first(spark, d):
    return schema.id_first(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey")

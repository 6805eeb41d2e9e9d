"""Spreading of hot keys, positions and ranks, the shared folder."""

import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cleanframe.functions.columns import bound_index
from cleanframe.operators import history, numeric
from cleanframe.operators.dedup import detect
from cleanframe.plans import ordering, skew
from cleanframe.plans.storage import cut_lineage, shared_dir, stored
from tests.conftest import rows
from tests.test_dedup import SCHEMA, brute, groups_of, lloyd, people


@pytest.fixture
def hot_from_five(monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_spread(spark, hot_from_five, how):
    big = spark.createDataFrame([(i, 7 if i < 300 else i % 11) for i in range(900)] + [(-1, None)], "n long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(9)], "k long, v string")
    joined = skew.spread_lookup(big, small, ["k"], how)
    assert rows(joined) == rows(big.join(small, "k", how))


def test_only_hot_keys_are_repeated(spark, hot_from_five):
    big = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000, 2)], "n long, k long")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    plan = skew.spread_lookup(big, small, ["k"])._jdf.queryExecution().toString()
    assert "_salt" in plan and "CartesianProduct" not in plan


def test_duplicates_with_hot_keys(spark, hot_from_five):
    table = people(100, 8, hot=0.5)
    result = detect.find_duplicates(spark.createDataFrame(table, SCHEMA), "city", ["kind"], ["name"])
    kept = {r[0] for r in result.rows.select("id").collect()}
    pairs = list(brute([r for r in table if r[0] in kept], "city", ["kind"], ["name"]))
    _, match = lloyd([v for _, _, v in pairs])
    want = groups_of([(a, b) for (a, b, _), m in zip(pairs, match) if m])
    found = {}
    for r in result.clusters.collect():
        found.setdefault(r["group_id"], []).append(r["id"])
    assert sorted(sorted(g) for g in found.values()) == want


def test_duplicates_on_the_key_alone(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "A", 2), (3, "b", 3), (4, None, 4), (5, "c", 5)], "id long, k string, x int")
    assert rows(detect.find_duplicates(df, "k").clusters) == [(1, 1, False), (2, 1, False)]


@pytest.mark.parametrize("range_rows", [200_000, 7, 1])
def test_positions_with_a_hot_key(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", range_rows)
    data = [("hot" if i % 3 else f"k{i % 17:02}", i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, n long")
    got = [(r["k"], r["p"]) for r in ordering.with_position(df, ["k"], "p", 5).orderBy("p").collect()]
    assert got == [(k, i) for i, k in enumerate(sorted(k for k, _ in data), 5)]


@pytest.mark.parametrize("range_rows", [200_000, 3])
def test_values_at_ranks(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", range_rows)
    rng = random.Random(3)
    values = [rng.choice([1.5, 2.0, 2.0, -4.0, 100.0, rng.random()]) for _ in range(500)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    total, found = ordering.values_at_ranks(df, "x", lambda n: [0, 1, n // 3, n // 2, n - 1])
    ordered = sorted(v for v in values if v is not None)
    assert total == 500 and found == [ordered[i] for i in (0, 1, 500 // 3, 250, 499)]
    assert ordering.values_at_ranks(df.where("x > 1000"), "x", lambda n: [0]) == (0, [])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_quantile_bins_hold_every_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    binned = numeric.equal_frequency(df, "x", 4, "quantile", "bin").collect()
    assert all(r["bin"] is not None for r in binned)
    by_value = sorted((r["x"], r["bin"]) for r in binned)
    assert [b for _, b in by_value] == sorted(b for _, b in by_value)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=40, unique=True), st.integers(0, 60))
def test_bound_index(spark, edges, seed):
    edges = sorted(edges)
    rng = random.Random(seed)
    values = [rng.choice(edges), rng.uniform(-120, 120), -1e9, 1e9, None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(bound_index(F.col("x"), edges)).collect()
    assert [r[0] for r in got] == [None if v is None else sum(e < v for e in edges) for v in values]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=25))
def test_median(spark, values):
    from cleanframe.operators.profile import median
    assert median(spark.createDataFrame([(v,) for v in values], "x int"), "x") == statistics.median(values)


def test_history_rank_is_limited_before_the_shuffle(spark):
    plan = history.close_old_actions(history.empty_log(spark))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_storage(spark):
    df = spark.createDataFrame([(1, "a")], "id long, `a (b)` string")
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert rows(stored(df)) == rows(cut_lineage(df)) == [(1, "a")]


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    from cleanframe.operators import predicates, rows as row_ops
    line = spark.read.parquet(f"{data}/lineitem.parquet")
    plan = scan_of(predicates.remove_outliers(line, "l_quantity", 40).select("l_orderkey"))
    assert "PushedFilters: [Or(LessThanOrEqual(l_quantity,40.0),IsNull(l_quantity))]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    plan = scan_of(predicates.remove_where(line, [("", "l_tax", ">", "0.05"), ("AND", "l_returnflag", "=", "R")]))
    assert "PushedFilters: [Or(Or(LessThanOrEqual(l_tax,0.05),IsNull(l_tax)),Or(Not(" in plan
    plan = scan_of(predicates.select_where(line, [("", "l_shipdate", "<", "1995-01-01")]).select("l_tax"))
    assert "LessThan(l_shipdate,1995-01-01T00:00)" in plan
    assert "In(l_orderkey" in scan_of(row_ops.delete_ids(line, [1, 2, 3], "l_orderkey"))


def test_row_wise_operators_stay_in_one_stage(spark, data):
    from cleanframe.operators import dates, impute, numeric, replace
    orders = spark.read.parquet(f"{data}/orders.parquet")
    df = numeric.equal_width(impute.impute(orders, "o_totalprice", "AVG"), "o_totalprice", 5)
    df = dates.extract_part(replace.find_replace(df, "o_orderpriority", "regex", "H", "h"), "o_orderdate", "DOW")
    plan = scan_of(df)
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan and "*(1)" in plan

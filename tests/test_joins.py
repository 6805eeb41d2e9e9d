import itertools
import operator

import pytest

from cleanframe.operators.joins import Pair, join_tables, plan_joins
from cleanframe.plans import inequality
from cleanframe.plans.inequality import inequality_join, ranges_of_both
from tests.conftest import rows

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "<>": operator.ne}


@pytest.fixture
def tables(spark):
    return {
        "a": spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (3, None, "z")], "id long, k int, s string"),
        "b": spark.createDataFrame([(1, 10, 5), (2, 20, 6), (3, 20, 7)], "id long, k int, m int"),
        "c": spark.createDataFrame([(1, 5), (2, 6)], "id long, m int"),
    }


def test_equi_join(tables):
    got = join_tables(tables, [Pair("a", "k", "=", "b", "k")])
    assert got.columns == ["id", "a0_k", "a0_s", "b0_k", "b0_m"]
    assert rows(got) == [(1, 10, "x", 10, 5), (2, 20, "y", 20, 6), (3, 20, "y", 20, 7)]


def test_chain_in_any_order(tables):
    pairs = [Pair("a", "k", "=", "b", "k"), Pair("b", "m", "=", "c", "m")]
    for order in (pairs, pairs[::-1]):
        got = join_tables(tables, order)
        assert sorted(got.columns) == ["a0_k", "a0_s", "b0_k", "b0_m", "c0_m", "id"]
        assert rows(got, "a0_s", "c0_m") == [("x", 5), ("y", 6)]


def test_swapped_pair_keeps_direction(tables):
    got = join_tables(tables, [Pair("a", "k", "=", "b", "k"), Pair("c", "m", "<", "b", "m")])
    assert rows(got, "b0_m", "c0_m") == [(6, 5), (7, 5), (7, 6)]


def test_self_join_and_repeats(tables):
    got = join_tables(tables, [Pair("a", "k", "<", "a", "k"), Pair("a", "k", "=", "a", "k")])
    assert got.columns == ["id", "a0_k", "a0_s", "a1_k", "a1_s", "a2_k", "a2_s"]
    assert rows(got, "a0_k", "a1_k", "a2_k") == [(10, 20, 10)]


def test_plan_errors(tables):
    with pytest.raises(ValueError, match="comparison"):
        plan_joins([Pair("a", "k", "LIKE", "b", "k")])
    with pytest.raises(ValueError, match="cannot be joined"):
        plan_joins([Pair("a", "k", "=", "b", "k"), Pair("c", "m", "=", "d", "m")])
    with pytest.raises(ValueError, match="no table pair"):
        plan_joins([])
    with pytest.raises(ValueError, match="no such table"):
        join_tables(tables, [Pair("a", "k", "=", "zz", "k")])


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("side,pairs", [(10_000, 100_000_000), (3, 9), (2, 30)])
def test_inequality_join(spark, monkeypatch, op, side, pairs):
    monkeypatch.setattr(inequality, "SIDE_ROWS", side)
    monkeypatch.setattr(inequality, "RECTANGLE_PAIRS", pairs)
    left = [(i, v) for i, v in enumerate([1, 5, 5, 5, 9, 20, None, -3])]
    right = [(i, v) for i, v in enumerate([5.0] * 12 + [1.0, 0.5, 9.0, 9.5, None, 100.0, -7.0])]
    got = inequality_join(spark.createDataFrame(left, "i int, a int"), spark.createDataFrame(right, "j int, b double"),
                          "a", op, "b")
    want = sorted((i, a, j, b) for (i, a), (j, b) in itertools.product(left, right)
                  if a is not None and b is not None and OPS[op](a, b))
    assert sorted(tuple(r) for r in got.select("i", "a", "j", "b").collect()) == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_inequality_join_on_text(spark):
    left = spark.createDataFrame([("b",), ("d",)], "a string")
    right = spark.createDataFrame([("a",), ("b",), ("c",)], "b string")
    assert rows(inequality_join(left, right, "a", ">", "b"), "a", "b") == [
        ("b", "a"), ("d", "a"), ("d", "b"), ("d", "c")]


def test_rectangles_follow_both_sides():
    assert ranges_of_both(1_000, 1_000) == (1, 1)
    assert ranges_of_both(1_000_000, 1_000_000) == (100, 100)
    assert ranges_of_both(50_000_000, 100) == (50, 1) and ranges_of_both(100, 50_000_000) == (1, 50)
    assert ranges_of_both(0, 10) == (1, 1)


def test_tasks_grow_with_the_left_side(spark, monkeypatch):
    """A small right side and a large left one: the join has a task per rectangle, and a hot left value spans several."""
    monkeypatch.setattr(inequality, "SIDE_ROWS", 100)
    monkeypatch.setattr(inequality, "RECTANGLE_PAIRS", 1_000)
    right = spark.createDataFrame([(i,) for i in range(10)], "b long")
    tasks = {}
    for n in (1_000, 4_000):
        left = spark.range(n).selectExpr("id AS i", "CASE WHEN id % 3 = 0 THEN 5L ELSE id % 10 END AS a")
        joined = inequality_join(left, right, "a", "<", "b")
        tasks[n] = joined.rdd.getNumPartitions()
        assert joined.count() == sum(9 - (5 if i % 3 == 0 else i % 10) for i in range(n))
    assert tasks[1_000] == 10 and tasks[4_000] == 40

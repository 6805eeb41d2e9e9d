"""Joins of many tables along a list of column pairs."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from cleanframe.functions.columns import ref, require
from cleanframe.operators.predicates import COMPARISONS
from cleanframe.operators.schema import id_first
from cleanframe.plans.inequality import inequality_join
from cleanframe.plans.ordering import with_position
from cleanframe.plans.storage import stored


class Pair(NamedTuple):
    """`left_table.left_column op right_table.right_column`"""
    left_table: str
    left_column: str
    op: str
    right_table: str
    right_column: str


@dataclass(frozen=True)
class Step:
    """Join a new copy of `table` under the name `alias`: `left_name op right_name` on prefixed names."""
    table: str
    alias: str
    new_column: str
    known_column: str
    op: str
    new_is_left: bool


def _alias(table: str, occurrence: int) -> str:
    return f"{table}{occurrence}"


def plan_joins(pairs: list[Pair]) -> tuple[tuple[str, str], list[Step]]:
    """((first table, its alias), steps). Pairs are taken in the given order as soon as they touch a joined table.

    Every pair brings in a new copy of a table: the right one if the left one is there already, else the left
    one. The other side is always the first copy. Pairs that never connect are an error.
    """
    if not pairs:
        raise ValueError("no table pair given")
    pairs = [Pair(*p) for p in pairs]
    for pair in pairs:
        if pair.op not in COMPARISONS:
            raise ValueError(f"unknown comparison {pair.op!r}; choose one of {', '.join(COMPARISONS)}")
    first = pairs[0].left_table
    copies = {first: 1}
    steps: list[Step] = []
    waiting = list(pairs)
    while waiting:
        pair = next((p for p in waiting if p.left_table in copies or p.right_table in copies), None)
        if pair is None:
            raise ValueError("the tables cannot be joined into one: " + ", ".join(
                f"{p.left_table}-{p.right_table}" for p in waiting))
        waiting.remove(pair)
        new_is_left = pair.left_table not in copies
        table, new, known, known_table = (
            (pair.left_table, pair.left_column, pair.right_column, pair.right_table) if new_is_left
            else (pair.right_table, pair.right_column, pair.left_column, pair.left_table))
        alias = _alias(table, copies.get(table, 0))
        copies[table] = copies.get(table, 0) + 1
        steps.append(Step(table, alias, f"{alias}_{new}", f"{_alias(known_table, 0)}_{known}", pair.op, new_is_left))
    return (first, _alias(first, 0)), steps


def join_step(left: DataFrame, right: DataFrame, a: str, op: str, b: str) -> DataFrame:
    """`left.a op right.b` on tables without common column names; equality leaves the strategy to the planner."""
    if op == "=":
        return left.join(right, ref(a) == ref(b), "inner")
    return inequality_join(left, right, a, op, b)


def join_tables(tables: dict[str, DataFrame], pairs: list[Pair], id_col: str | None = "id") -> DataFrame:
    """Inner joins along `pairs`; each column becomes `<table><k>_<column>`.

    With `id_col`, every table must have that column: the source ids are dropped after ordering a fresh serial
    id by them. With None the result has no id, and no column is dropped.
    """
    (first, first_alias), steps = plan_joins(pairs)
    for name in [first, *(s.table for s in steps)]:
        if name not in tables:
            raise ValueError(f"no such table: {name}")
        if id_col:
            require(tables[name], id_col)

    def prefixed(table: str, alias: str) -> DataFrame:
        return tables[table].select(*[ref(c).alias(f"{alias}_{c}") for c in tables[table].columns])

    joined = prefixed(first, first_alias)
    for step in steps:
        new = prefixed(step.table, step.alias)
        if step.new_is_left:
            joined = join_step(new, joined, step.new_column, step.op, step.known_column).select(
                *[ref(c) for c in joined.columns + new.columns])
        else:
            joined = join_step(joined, new, step.known_column, step.op, step.new_column)
    if not id_col:
        return joined
    source_ids = [f"{alias}_{id_col}" for alias in [first_alias, *(s.alias for s in steps)]]
    return id_first(with_position(stored(joined), source_ids, id_col, 1).drop(*source_ids), id_col)

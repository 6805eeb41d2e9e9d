"""Jaccard join of word shingles over count vectors, and the groups that its links form.

A document is the set of its distinct k-word shingles. Two documents link when den * |A and B| >= num * |A or B|.

Equal sets are one node, described once. For unequal ones, the sets of a link differ in at most d = (|A| + |B|) (den - num) / (den + num)
shingles. Shingles are hashed into more than d groups, so some group holds the same shingles in both: documents meet in a
bucket for each (size level, group, group's shingles), and no link can miss all of its buckets.

Buckets with the same members count once. `linking` says how they are worked off without listing their pairs. Documents are points:
their shingles are hashed into `DIMENSIONS` groups, and the group counts are the coordinates. The overlap of two sets is at most the
sum of the smaller coordinates, which decides whether a pair is verified on its exact sets. Blocks of a bucket that still holds several
groups are packed into R-trees; two tree nodes whose upper corners sum to less than a link of their sizes needs, or that hold one
group alone, are passed over as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, floor, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import mix, unused
from cleanframe.llm.linking import Close, Compare, Linker, Nodes, bounded_batches, buckets, described, groups_of, sets_of
from cleanframe.llm.shingles import ODD, Rule, count_codes, overlap_bound
from cleanframe.plans.storage import Scratch, stored

LEAF = 32
BLOCK = 4_000
FOUND = 20_000
LEVEL_RATIO = 1.6
ROUNDS = 8


@lru_cache(maxsize=None)
def _level(rule: Rule, level: int) -> tuple[int, int, int, int]:
    """(smallest size, first size beyond, groups, empty groups that a set may have without listing them)."""
    low = 1 if level == 0 else _level(rule, level - 1)[1]
    high = max(low + 1, floor(low * LEVEL_RATIO))
    most = high - 1 + (high - 1) * rule.den // rule.num
    differ = most * (rule.den - rule.num) // (rule.den + rule.num)
    groups, spare = differ + 1, 0
    for _ in range(20):
        empty = groups * exp(-low / groups)
        spare = ceil(empty + 6 * sqrt(empty)) + 1
        if differ + 1 + spare == groups:
            break
        groups = differ + 1 + spare
    if spare > differ / 3:
        groups, spare = differ + 1, -1
    return low, high, groups if differ else 0, spare


def _class_of(rule: Rule, size: int) -> int:
    level = 0
    while _level(rule, level)[1] <= size:
        level += 1
    return level


def bucket_keys(found: np.ndarray, rule: Rule) -> np.ndarray:
    """The buckets of a set: 48-bit hashes of (level, group, shingles in the group), from the level of the smallest
    possible partner to its own. Empty groups are listed by sets with more of them than the level spares."""
    size = len(found)
    parts = []
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(found ^ ODD), dtype=np.uint64))
    for level in range(_class_of(rule, max(1, rule.smallest_partner(size))), _class_of(rule, size) + 1):
        _, _, groups, spare = _level(rule, level)
        if not groups:
            continue
        edges = np.searchsorted((found >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32), np.arange(groups + 1, dtype=np.uint64))
        content = sums[edges[1:]] - sums[edges[:-1]]
        names = mix(mix(content + np.uint64(level + 1)) * ODD + np.arange(groups, dtype=np.uint64))
        empty = edges[1:] == edges[:-1]
        parts.append(names[~empty] if empty.sum() <= spare else names)
    return (np.concatenate(parts) >> np.uint64(16)).astype(np.int64) if parts else np.zeros(0, np.int64)


class Tree:
    """A packed R-tree over count vectors: leaves of `LEAF` points in the order of (component, size, coordinates), and
    above them nodes of as many children, each with its upper corner, its smallest and largest size and its component
    (-1 if it holds several)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.order = np.lexsort([*points.T[:3], sizes, component])
        self.points, self.sizes = points[self.order], sizes[self.order]
        _, self.component = np.unique(component, return_inverse=True)
        self.component = self.component[self.order]
        self.levels = []
        top, low, high, own = self.points, self.sizes, self.sizes, self.component
        while True:
            starts = np.arange(0, len(top), LEAF)
            same = np.maximum.reduceat(own, starts) == np.minimum.reduceat(own, starts)
            own = np.where(same, np.minimum.reduceat(own, starts), -1)
            top, low, high = np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((top, low, high, own))
            if len(top) == 1:
                break

    def join(self, other: "Tree", rule: Rule, components: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Pairs (row here, row there) of different components whose bound allows a link. `components` gives the points'
        components on one scale for both trees."""
        return np.concatenate([np.zeros((0, 2), np.int64), *self.pairs(other, rule, components)])

    def pairs(self, other: "Tree", rule: Rule, components: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
        """What `join` gives, some at a time. Of a tree with itself, a pair comes in one order or in both."""
        mine, theirs = components[0][self.order], components[1][other.order]
        depth = max(len(self.levels), len(other.levels))
        left = right = np.zeros(1, np.int64)
        for level in range(depth - 1, -1, -1):
            a, b = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            if other is self:
                left, right = left[left <= right], right[left <= right]
            keep = self._may_link(a, b, left, right, rule)
            left, right = left[keep], right[keep]
            if not level:
                break
            left, right = _children(left, right, _fan(self, level), _fan(other, level))
        found, held = [], 0
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
            least = overlap_bound(self.points[x][:, None, :], other.points[y][None, :, :])
            total = self.sizes[x][:, None] + other.sizes[y][None, :]
            p, q = np.nonzero((least >= rule.needed(total)) & (mine[x][:, None] != theirs[y][None, :]))
            if len(p):
                found.append(np.column_stack([self.order[p + i * LEAF], other.order[q + j * LEAF]]))
                held += len(p)
            if held > FOUND:
                yield np.concatenate(found)
                found, held = [], 0
        if found:
            yield np.concatenate(found)

    @staticmethod
    def _may_link(a, b, left, right, rule: Rule) -> np.ndarray:
        keep = np.zeros(len(left), bool)
        for s in range(0, len(left), 16_384):
            i, j = left[s:s + 16_384], right[s:s + 16_384]
            least = overlap_bound(a[0][i], b[0][j])
            sizes = (rule.den * b[2][j] >= rule.num * a[1][i]) & (rule.den * a[2][i] >= rule.num * b[1][j])
            keep[s:s + 16_384] = (least >= rule.needed(a[1][i] + b[1][j])) & sizes & ((a[3][i] < 0) | (a[3][i] != b[3][j]))
        return keep


def _fan(tree: Tree, level: int):
    """Children at the level below, for the nodes at `level`; a tree without such a level keeps its root."""
    if level >= len(tree.levels):
        return None
    return len(tree.levels[level - 1][0])


def _children(left, right, left_count, right_count):
    def spread(nodes, count):
        if count is None:
            return nodes, np.ones(len(nodes), np.int64)
        return nodes * LEAF, np.minimum(LEAF, count - nodes * LEAF)

    a, na = spread(left, left_count)
    b, nb = spread(right, right_count)
    pairs = na * nb
    place = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    wide = np.repeat(nb, pairs)
    return np.repeat(a, pairs) + place // wide, np.repeat(b, pairs) + place % wide


def tree_join(rule: Rule) -> Compare:
    """Compares two blocks, or one with itself, by their R-trees."""

    def compare(size: np.ndarray, points: np.ndarray, component: np.ndarray, side: np.ndarray, key: int) -> Iterator[np.ndarray]:
        _, component = np.unique(component, return_inverse=True)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            tree = Tree(points, size, component)
            yield from tree.pairs(tree, rule, (component, component))
            return
        # Components of the two trees are compared point by point; whole nodes of one component are not passed over here.
        one, two = Tree(points[x], size[x], component[x]), Tree(points[y], size[y], component[y])
        for tree, own in ((one, component[x]), (two, component[y])):
            tree.levels = [(t, lo, hi, np.where(c >= 0, own[tree.order][np.minimum(np.arange(len(c)) * LEAF ** (k + 1), len(own) - 1)], -1))
                           for k, (t, lo, hi, c) in enumerate(tree.levels)]
        for pairs in one.pairs(two, rule, (component[x], component[y])):
            yield np.column_stack([x[pairs[:, 0]], y[pairs[:, 1]]])

    return compare


def bounded(rule: Rule) -> Close:
    """Whether sizes and counts allow a link."""

    def close(n: np.ndarray, counts: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
        return overlap_bound(counts, others) >= rule.needed(n + m)

    return close


def jaccard_groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links.

    A NULL text or one without words has no shingles and stays alone. Rows that repeat an id or a text are linked like any
    others; a row without id is linked too and gets the smallest id of its group, NULL if there is none. No rows give none. The tables
    that the result is read from stay in the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    with bounded_batches(spark):
        nodes = Nodes(scratch, described(docs, rule, id_col, text, count_codes, lambda found: bucket_keys(found, rule)))
        met = scratch.put(buckets(nodes.points.select("node", F.explode("keys").alias("key"))))
        nodes.forget("keys")
        linker = Linker(scratch, nodes, rule, bounded(rule), lambda holders: nodes.named(sets_of(docs, holders, rule, id_col, text)))
        component = linker.run(met, tree_join(rule), BLOCK, ROUNDS)
        return groups_of(nodes, component)


def one_of_each_group(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that come first in their group by id, rows without id last, then by a hash of the text.

    Rows are told apart by id and text, so of two texts under one id only the one that has an earlier near copy goes. Of rows that
    repeat id and text the smallest stays.
    """
    key = unused(docs, "_row")
    value = F.struct(ref(id_col).isNull().alias("none"), ref(id_col).alias("id"), F.xxhash64(ref(text)).alias("text"))
    named = docs.withColumn(key, F.to_json(value, {"ignoreNullFields": "false"}))
    order = F.struct(ref(id_col).isNull().alias("none"), ref(id_col).alias("id"), F.xxhash64(ref(text)).alias("text"), F.col(key).alias("row"))
    groups = stored(jaccard_groups(named, rule, key, text).select(F.col("doc_id").alias(key), F.col("component_id").alias("_group")))
    members = stored(named.select(key, order.alias("_order")).join(groups.distinct(), key))
    first = members.groupBy("_group").agg(F.min("_order").alias("_order")).select(F.col("_order.row").alias(key))
    columns = [ref(c) for c in docs.columns]
    kept = named.join(stored(first), key, "left_semi")
    repeated = stored(members.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key))
    if repeated.isEmpty():
        return kept.select(*columns)
    least = (kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*columns)).alias(key + "_least"))
             .select(F.col(key + "_least").alias("least")).select("least.*"))
    return kept.join(repeated, key, "left_anti").select(*columns).unionByName(least)

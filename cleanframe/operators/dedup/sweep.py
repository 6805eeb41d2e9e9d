"""Pairs of near numbers by sweeps over sorted values, for comparisons with one column of numbers.

How many pairs are closer than a bound, and how similar they are in sum and sum of squares, follows from running sums over sorted
values: a value asks for the sums up to both ends of its reach, and similarity is linear between them. So candidates are summed up,
and clustered, in time that grows with the values and not with their pairs.

Values are cut into buckets as wide as the reach of the similarity. A bucket is swept with the values of both neighbours, in
coordinates of its own, so sums stay small and exact enough, and a block with many values is spread over many tasks.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.functions.similarity import NUMBER_OFFSET, NUMBER_REACH, NUMBER_SCALE
from cleanframe.operators.dedup.blocks import DATE, NUMBER, PAIR_COUNT, Dimension
from cleanframe.operators.dedup.classify import TIE, Rule, settle
from cleanframe.operators.dedup.vectors import agreeing_pairs, groups_of, has, sides, similar_groups, subsets_of
from cleanframe.plans.storage import stored

FALL = 2 * NUMBER_SCALE
#: Doubles from here on are further apart than the reach, so that only equal ones are near.
APART = 2.7e17
PLACE = ["_cell", "_bucket", "_large"]


def only_number(dims: list[Dimension]) -> int | None:
    numbers = [i for i, d in enumerate(dims) if d.how == NUMBER]
    return numbers[0] if len(numbers) == 1 else None


def reach_of(level: Column | float) -> Column | float:
    """Values closer than this are more similar than `level`, which is below 1."""
    return NUMBER_OFFSET + FALL * (1 - level)


def _placed(df: DataFrame, value: Column, around: bool) -> DataFrame:
    """Rows with their bucket and place in it; with `around` also in the two buckets beside it. NaN and infinity are near nothing."""
    df = df.withColumn("_x", value.cast("double")).where(~F.isnan("_x") & (F.abs("_x") < float("inf")))
    large = F.abs("_x") >= APART
    bucket = F.floor(F.col("_x") / NUMBER_REACH)
    buckets = F.array(*[bucket + i for i in ((-1, 0, 1) if around else (0,))])
    df = df.withColumn("_bucket", F.explode(F.when(large, F.array(F.lit(0).cast("long"))).otherwise(buckets)))
    return (df.withColumn("_large", F.when(large, F.col("_x")))
            .withColumn("_pos", F.when(large, 0.0).otherwise(F.col("_x") - NUMBER_REACH * F.col("_bucket"))).drop("_x"))


class Sides:
    """The groups compared by number, with the discrete columns' levels, as those that ask (`sources`) and those asked (`targets`)."""

    def __init__(self, groups: DataFrame, tuples: DataFrame, dims: list[Dimension]):
        q = self.number = only_number(dims)
        self.others = [i for i in range(len(dims)) if i != q]
        self.classes = ["same", *[f"l{i}" for i in self.others]]
        asking, asked = sides(groups.where(has(F.col("_set"), q)), tuples, dims)

        def cell(rank: str, parts: list[str]) -> Column:
            return F.struct(F.col(rank).alias("r"), F.col("_set").alias("s"), *[F.col(p).alias(f"k{i}") for i, p in enumerate(parts)])

        itself = reduce(lambda a, b: a & b, [F.col(f"b{i}").eqNullSafe(F.col(f"v{i}")) for i in self.others], F.col("same") == 1)
        sources = asking.select(cell("_rank_b", [f"b{i}" for i in self.others]).alias("_cell"), "_set", *self.classes, "_own", "_n", "_rep",
                                itself.alias("_self"), F.col(f"v{q}"))
        targets = asked.select(cell("_rank", [f"v{i}" for i in self.others]).alias("_cell"), "_set", "_other", "_n_other", "_rep_other", F.col(f"v{q}"))
        self.sources = stored(_placed(sources, F.col(f"v{q}"), around=False).drop(f"v{q}"))
        self.targets = stored(_placed(targets, F.col(f"v{q}"), around=True).drop(f"v{q}"))


def _sums(found: Sides, asking: DataFrame, squares: bool) -> list:
    """Per class and `_mask` of the asking rows: the ordered pairs closer than `_reach`, and the sum (and sum of squares) of their levels."""
    x = F.col("_pos")
    asks = [("far right", x + F.col("_reach"), -1), ("far left", x - F.col("_reach"), 1), ("right", x + NUMBER_OFFSET, 1), ("left", x - NUMBER_OFFSET, -1)]
    ask = F.explode(F.array(*[F.struct(F.lit(name).alias("what"), at.alias("at"), F.lit(kind).alias("kind")) for name, at, kind in asks]))
    questions = asking.withColumn("_ask", ask).select(
        *PLACE, F.col("_ask.at").alias("_at"), F.col("_ask.kind").alias("_kind"), F.col("_ask.what").alias("_what"), F.lit(0).cast("long").alias("_m"),
        "_n", x.alias("_x"), *found.classes, "_mask")
    answers = found.targets.select(*PLACE, x.alias("_at"), F.lit(0).alias("_kind"), F.col("_n_other").alias("_m"))
    running = Window.partitionBy(*PLACE).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    at, m = F.col("_at"), F.col("_m")
    swept = (answers.unionByName(questions, allowMissingColumns=True)
             .withColumn("_c", F.sum(m).over(running)).withColumn("_s", F.sum(m * at).over(running)).withColumn("_q", F.sum(m * at * at).over(running))
             .where("_kind != 0"))
    count, total, square, what = F.col("_c"), F.col("_s"), F.col("_q"), F.col("_what")
    right = 1 + NUMBER_OFFSET / FALL + F.col("_x") / FALL
    left = 1 + NUMBER_OFFSET / FALL - F.col("_x") / FALL
    levels = (right * count - total / FALL, left * count + total / FALL)
    squared = (right * right * count - 2 * right / FALL * total + square / FALL**2, left * left * count + 2 * left / FALL * total + square / FALL**2)

    def share(of: tuple[Column, Column]) -> Column:
        """Within the offset similarity is 1, beyond it falls on either side up to the reach."""
        return (F.when(what == "far right", of[0]).when(what == "far left", -of[1]).when(what == "right", count - of[0]).otherwise(of[1] - count)
                * F.col("_n"))

    pairs = F.when(what == "far right", count).when(what == "far left", -count).otherwise(0)
    sums = [F.sum((pairs.cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)")).cast(PAIR_COUNT)).alias("pairs"), F.sum(share(levels)).alias("levels")]
    if squares:
        sums.append(F.sum(share(squared)).alias("squares"))
    counted = swept.groupBy(*found.classes, "_mask").agg(*sums)
    own = asking.where("_self").groupBy(*found.classes, "_mask").agg(F.sum("_n").alias("_own_rows"))
    return counted.join(own, [*found.classes, "_mask"], "left").collect()


class Summary:
    """Candidate pairs per vector of the discrete columns: how many have no near numbers, and how many have, with their levels' sums.

    What the driver holds are sums per vector, as many as the levels of the columns combine to.
    """

    def __init__(self, tuples: DataFrame, dims: list[Dimension]):
        self.dims, self.number = dims, only_number(dims)
        groups = stored(groups_of(subsets_of(tuples, dims), dims))
        self.sides = Sides(groups, tuples, dims)
        self.near = self._near(None)
        #: vector -> pairs without near numbers; vector -> (pairs, levels, squares) with them.
        self.far: dict[tuple, int] = defaultdict(int)
        plain = similar_groups(groups.where(~has(F.col("_set"), self.number)), tuples, dims)
        for row in agreeing_pairs(plain, dims).collect():
            levels = [row["same"], *[row[f"l{i}"] for i in self.sides.others]]
            for sign, vector, _ in self._cleared(tuple(levels)):
                self.far[vector] += sign * int(row["_pairs"])
        for vector, (pairs, *_) in self.near.items():
            self.far[vector] -= pairs
        # Inside a block each pair was met from both sides, pairs between blocks counted twice.
        self.far = {v: n // 2 for v, n in self.far.items() if n}
        self.near = {v: (n // 2, s / 2, q / 2) for v, (n, s, q) in self.near.items() if n}

    def _cleared(self, levels: tuple):
        """(sign, vector, mask) for each choice of agreeing columns to leave out, as inclusion and exclusion needs it."""
        agreeing = [k for k in range(1, len(levels)) if levels[k] > 0]
        for mask in product((0, 1), repeat=len(agreeing)):
            gone = {k for k, bit in zip(agreeing, mask) if bit}
            yield (-1) ** len(gone), tuple(0.0 if k in gone else x for k, x in enumerate(levels)), sum(1 << k for k in gone)

    def _near(self, reach: dict[tuple, float] | None) -> dict[tuple, tuple]:
        """Per vector (pairs, levels, squares) of the pairs with numbers closer than its reach, still counted twice; without `reach`, of all near ones."""
        spark, classes = self.sides.sources.sparkSession, self.sides.classes
        if reach is None:
            asking = self.sides.sources.withColumn("_mask", F.lit(0)).withColumn("_reach", F.lit(NUMBER_REACH))
        else:
            wanted = [(*levels, mask, float(reach[vector])) for levels in self.agreeing for _, vector, mask in self._cleared(levels) if vector in reach]
            if not wanted:
                return {}
            bounds = spark.createDataFrame(wanted, ", ".join(f"{c} double" for c in classes) + ", _mask int, _reach double")
            asking = self.sides.sources.join(F.broadcast(bounds), classes)
        rows = _sums(self.sides, asking, reach is None)
        out: dict[tuple, list] = defaultdict(lambda: [0, 0.0, 0.0])
        if reach is None:
            self.agreeing = [tuple(r[c] for c in classes) for r in rows]
        for row in rows:
            levels = tuple(row[c] for c in classes)
            own = row["_own_rows"] or 0
            times = 1 if levels[0] == 1 else 2
            sums = [times * (int(row["pairs"]) - own), times * (row["levels"] - own), times * (row["squares"] - own if reach is None else 0.0)]
            for sign, vector, mask in self._cleared(levels):
                if reach is None or (mask == row["_mask"] and vector in reach):
                    out[vector] = [a + sign * b for a, b in zip(out[vector], sums)]
        return {v: tuple(s) for v, s in out.items()}

    def rows(self) -> list[tuple]:
        """(vector, pairs, near, levels, squares): all pairs, and of those with near numbers the number and the sums of levels and squares."""
        nothing = (0, 0.0, 0.0)
        return [(v, self.far.get(v, 0) + self.near.get(v, nothing)[0], *self.near.get(v, nothing)) for v in {**self.far, **self.near}
                if self.far.get(v, 0) + self.near.get(v, nothing)[0]]

    def _split(self, rule: Rule, vector: tuple, against: bool = False) -> tuple[float, float]:
        """(score without near numbers, weight of the number's level)."""
        weights = [*rule.weights]
        weight = weights.pop(self.number + 1)
        return sum(w * x for w, x in zip(weights, vector)) - rule.limit, weight

    def _beyond(self, base: float, weight: float) -> float:
        """The level beyond which the score is a match (or below which, for a negative weight)."""
        return (TIE - base) / weight if weight else (-1.0 if base > TIE else 2.0)

    def matching(self, rule: Rule) -> tuple[int, list[float]]:
        """(number of matching pairs, their sum of each column's level)."""
        count, sums = 0, [0.0] * (len(self.dims) + 1)
        reach, below = {}, {}

        def add(vector, pairs, levels):
            nonlocal count
            count += pairs
            order = [vector[0], *vector[1:self.number + 1], None, *vector[self.number + 1:]]
            for k, x in enumerate(order):
                sums[k] += levels if x is None else x * pairs

        for vector, pairs in self.far.items():
            if self._split(rule, vector)[0] > TIE:
                add(vector, pairs, 0.0)
        for vector, (pairs, levels, _) in self.near.items():
            base, weight = self._split(rule, vector)
            level = self._beyond(base, weight)
            if weight < 0:
                level = min(max(level, 0.0), 2.0)
                if base > TIE and level > 1:
                    add(vector, pairs, levels)
                elif base > TIE:
                    below[vector] = reach_of(level)
            elif level < 0:
                add(vector, pairs, levels)
            elif level < 1:
                reach[vector] = min(reach_of(level), NUMBER_REACH)
        if reach or below:
            for vector, (pairs, levels, _) in self._near({**reach, **below}).items():
                if vector in below:
                    add(vector, self.near[vector][0] - pairs // 2, self.near[vector][1] - levels / 2)
                else:
                    add(vector, pairs // 2, levels / 2)
        return count, sums

    def two_means(self) -> Rule | None:
        order = list(range(len(self.dims) + 1))
        total, sums, squares = 0, [0.0 for _ in order], [0.0 for _ in order]
        for vector, pairs, _, levels, square in self.rows():
            total += pairs
            place = [*vector[:self.number + 1], None, *vector[self.number + 1:]]
            for k, x in enumerate(place):
                sums[k] += levels if x is None else x * pairs
                squares[k] += square if x is None else x * x * pairs

        def halves(rule: Rule):
            count, matched = self.matching(rule)
            found = {True: (count, matched)} if count else {}
            if total > count:
                found[False] = (total - count, [s - m for s, m in zip(sums, matched)])
            return found

        return settle(total, sums, squares, halves) if total else None

    def undecided(self, rule: Rule) -> bool:
        """Could some pair match only because a column that speaks against a match does not agree?"""
        against = sum(w for w in rule.weights[1:] if w < 0)
        if against >= 0:
            return False
        same, *weights = rule.weights
        helpful = [w for i, w in enumerate(weights) if i != self.number]
        weight = weights[self.number]
        for vector in {**self.far, **self.near}:
            score = same * vector[0] + sum(max(w, 0.0) * x for w, x in zip(helpful, vector[1:])) - rule.limit
            base = self._split(rule, vector)[0]
            far = vector in self.far and base > TIE and score + against <= TIE
            # The least similar numbers with which a pair of this vector may match.
            least = max(0.0, self._beyond(base, weight)) if weight > 0 else 0.0
            near = vector in self.near and least < 1 and base + max(weight, 0.0) > TIE and score + max(weight, 0.0) * least + against <= TIE
            if far or near:
                return True
        return False


def near_links(groups: DataFrame, tuples: DataFrame, dims: list[Dimension], enough) -> DataFrame:
    """(_own, _rep, _other, _rep_other) between groups compared by number, so that the groups of all pairs more similar than
    `enough` (a column of the level, from `same` and the discrete levels) are connected.

    In sorted order it suffices to link each value to the nearest one of the other side before and behind it: between two values within
    reach of each other, all nearest ones are within reach as well.
    """
    found = Sides(groups, tuples, dims)
    level = F.greatest(enough, F.lit(0.0))
    sources = found.sources.withColumn("_reach", F.least(reach_of(level), F.lit(NUMBER_REACH))).where(level < 1)
    kind = F.struct(*found.classes)
    dates = [i for i in found.others if dims[i].how == DATE]
    choices = []
    for same, *slips in product((0.0, 1.0), *[(0.5, 1.0)] * len(dates)):
        of = dict(zip(dates, slips))
        choices.append(F.struct(F.lit(same).alias("same"), *[F.when(has(F.col("_set"), i), of.get(i, 1.0)).otherwise(0.0).alias(f"l{i}")
                                                             for i in found.others]))
    targets = found.targets.withColumn("_class", F.explode(F.array_distinct(F.array(*choices))))
    end = F.struct("_pos", "_group", "_rep", "_reach")
    asks = sources.select(*PLACE, kind.alias("_class"), "_pos", F.lit(1).alias("_kind"), F.col("_own").alias("_group"), "_rep", "_reach")
    asked = targets.select(*PLACE, "_class", "_pos", F.lit(0).alias("_kind"), F.col("_other").alias("_group"), F.col("_rep_other").alias("_rep"),
                           F.lit(None).cast("double").alias("_reach"))
    both = asks.unionByName(asked)
    by = Window.partitionBy(*PLACE, "_class")
    near = []
    for name, window in (("before", by.orderBy("_pos", "_kind")), ("behind", by.orderBy(F.desc("_pos"), F.desc("_kind")))):
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        for side in (0, 1):
            both = both.withColumn(f"_{name}{side}", F.last(F.when(F.col("_kind") == side, end), ignorenulls=True).over(upto))
        near.append(F.when(F.col("_kind") == 1, F.col(f"_{name}0")).otherwise(F.col(f"_{name}1")))
    linked = both.withColumn("_to", F.explode(F.filter(F.array(*near), lambda x: x.isNotNull())))
    linked = linked.where(F.abs(F.col("_pos") - F.col("_to._pos")) < F.coalesce("_reach", "_to._reach"))
    return linked.select(F.col("_group").alias("_own"), "_rep", F.col("_to._group").alias("_other"), F.col("_to._rep").alias("_rep_other")).distinct()

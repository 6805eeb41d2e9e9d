"""Two-means classification of comparison vectors into matches and non-matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Start centres, relative tolerance and most rounds of the clustering.
START_NO_MATCH, START_MATCH = 0.05, 0.95
TOLERANCE = 1e-4
MAX_ROUNDS = 300


@dataclass(frozen=True)
class Rule:
    """A pair matches when it is strictly nearer to the match centre, i.e. when `weights . vector > limit`."""
    no_match: tuple[float, ...]
    match: tuple[float, ...]

    @property
    def weights(self) -> list[float]:
        return [m - n for n, m in zip(self.no_match, self.match)]

    @property
    def limit(self) -> float:
        return (sum(m * m for m in self.match) - sum(n * n for n in self.no_match)) / 2

    def score(self, vector: list) -> float | Column:
        """weights . vector - limit; a match when above 0. Works on numbers and on columns."""
        return sum((w * x for w, x in zip(self.weights, vector)), -self.limit)


# The limit and the weighted sum carry rounding errors; a difference this small is a tie, which is no match.
TIE = 1e-9


def settle(total: float, sums: list[float], squares: list[float], halves, max_rounds: int = MAX_ROUNDS) -> Rule | None:
    """The clustering's rounds from fixed start centres; None when no vector is nearer to the match centre, an error when the centres have
    not settled after `max_rounds`. `halves(rule)` gives {match: (pairs, sum of each column)} of the sides that have pairs."""
    columns = range(len(sums))
    variances = [squares[i] / total - (sums[i] / total) ** 2 for i in columns]
    enough = TOLERANCE * sum(variances) / len(variances)
    rule = Rule((START_NO_MATCH,) * len(sums), (START_MATCH,) * len(sums))
    for _ in range(max_rounds):
        found = halves(rule)
        if True not in found:
            return None

        def centre(label, old):
            return tuple(found[label][1][i] / found[label][0] for i in columns) if label in found else old

        moved = Rule(centre(False, rule.no_match), centre(True, rule.match))
        shift = sum((a - b) ** 2 for a, b in zip(moved.no_match + moved.match, rule.no_match + rule.match))
        rule = moved
        if shift <= enough:
            return rule
    raise RuntimeError(f"the centres still move after {max_rounds} rounds")


def two_means(vectors: DataFrame, columns: list[str], weight: str = "pairs",
              max_rounds: int = MAX_ROUNDS) -> Rule | None:
    """Cluster weighted vectors. Each round is one aggregate over distinct vectors, and the driver sees the two centres only."""
    w = F.col(weight).cast("double")
    spread = vectors.agg(F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
                         *[F.sum(w * F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    if not spread["n"]:
        return None

    def halves(rule: Rule):
        match = (rule.score([F.col(c) for c in columns]) > TIE).alias("match")
        return {r["match"]: (r["n"], [r[f"s{i}"] for i in range(len(columns))]) for r in vectors.groupBy(match).agg(
            F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)]).collect()}

    return settle(spread["n"], [spread[f"s{i}"] for i in range(len(columns))], [spread[f"q{i}"] for i in range(len(columns))], halves, max_rounds)


def classify(vectors: DataFrame, columns: list[str], rule: Rule) -> DataFrame:
    return vectors.withColumn("match", rule.score([F.col(c) for c in columns]) > TIE)

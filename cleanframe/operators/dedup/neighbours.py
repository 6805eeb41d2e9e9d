"""Similar values of one column in the same or the next block.

Each function takes the distinct (_rank, v) of a column and returns (_rank, v, _rank_b, b, level) with
_rank_b either _rank or _rank + 1 and level above 0. Both directions are listed inside a block, and each value
is its own neighbour. Only values that are similar come out; candidates are found by equality on something
similar values must share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.similarity import (CONFUSED_MONTHS, DATE_SLIP, NUMBER_REACH, allowed_edits, date_level,
                                             text_level)
from cleanframe.plans.skew import spread_lookup


def _same_and_next() -> Column:
    return F.explode(F.array(F.col("_rank"), F.col("_rank") + 1))


def _identical(values: DataFrame) -> DataFrame:
    other = values.select(F.col("_rank").alias("_rank_b"), F.col("v").alias("b"))
    first = values.withColumn("_rank_b", _same_and_next())
    return (first.join(other.withColumn("v", F.col("b")), ["_rank_b", "v"])
            .select("_rank", "v", "_rank_b", "b", F.lit(1.0).alias("level")))


def number_bucket(value: Column) -> Column:
    """Numbers closer than the reach of the similarity lie in the same or an adjacent bucket."""
    limit = F.lit(9.0e15)
    return F.floor(F.least(F.greatest(value.cast("double") / NUMBER_REACH, -limit), limit)).cast("long")


def date_neighbours(values: DataFrame) -> DataFrame:
    """Equal timestamps, and those on a date that the slips of the date similarity lead to."""
    y, m, d = F.year("v"), F.month("v"), F.day("v")
    day = F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    slips = [F.struct(y.alias("y"), d.alias("m"), m.alias("d"))]
    slips += [F.when(m == one, F.struct(y.alias("y"), F.lit(other).alias("m"), d.alias("d")))
              for one, other in CONFUSED_MONTHS]
    first = (values.withColumn("_rank_b", _same_and_next())
             .withColumn("_day", F.explode(F.array_distinct(F.filter(F.array(*slips), lambda s: s.isNotNull())))))
    other = values.select(F.col("_rank").alias("_rank_b"), F.col("v").alias("b"), day.alias("_day"))
    slipped = (first.join(other, ["_rank_b", "_day"]).where(date_level(F.col("v"), F.col("b")) == DATE_SLIP)
               .select("_rank", "v", "_rank_b", "b", F.lit(DATE_SLIP).alias("level")).distinct())
    return _identical(values).unionByName(slipped)


def _pieces(text: Column) -> Column:
    """(token, at): `text` cut into one piece more than the edits allowed for its length, one character between
    two pieces left out. No edit, a transposition included, reaches two pieces, so a similar text that is not
    longer holds one piece unchanged, moved by at most the allowed edits."""
    length, edits = F.length(text), allowed_edits(text, text)
    base = F.floor((length - edits) / (edits + 1)).cast("int")
    longer = (length - edits) - base * (edits + 1)

    def piece(i):
        start = i * base + F.least(i, longer) + i
        size = base + F.when(i < longer, 1).otherwise(0)
        return F.struct(text.substr(start + 1, size).alias("token"), start.alias("at"))

    return F.transform(F.sequence(F.lit(0), edits), piece)


def _windows(text: Column) -> Column:
    """(token, at): all substrings of the sizes that pieces have, 2 and 3, and 1 for the shortest texts."""
    length = F.length(text)

    def of_size(size: int, when: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(length - size, F.lit(0)))
        cut = F.transform(starts, lambda i: F.struct(text.substr(i + 1, F.lit(size)).alias("token"), i.alias("at")))
        return F.when(when & (length >= size), cut).otherwise(F.filter(cut, lambda _: F.lit(False)))

    return F.concat(of_size(1, length <= 4), of_size(2, F.lit(True)), of_size(3, F.lit(True)))


def text_neighbours(values: DataFrame) -> DataFrame:
    """Texts above the similarity threshold, found by shared pieces and verified by their edit distance."""
    v = F.col("v")
    longer = (values.where(F.length(v) >= 4).select(
        F.col("_rank").alias("ra"), v.alias("a"), F.length(v).alias("la"), allowed_edits(v, v).alias("edits"),
        F.explode(_pieces(v)).alias("p"))
        .withColumn("rb", F.explode(F.array(*[F.col("ra") + i for i in (-1, 0, 1)])))
        .select("ra", "a", "la", "edits", "rb", F.col("p.token").alias("token"), F.col("p.at").alias("at_a")))
    shorter = (values.where(F.length(v) >= 3).select(
        F.col("_rank").alias("rb"), v.alias("b"), F.length(v).alias("lb"), F.explode(_windows(v)).alias("p"))
        .select("rb", "b", "lb", F.col("p.token").alias("token"), F.col("p.at").alias("at_b")))
    fits = ((F.col("lb") >= F.col("la") - F.col("edits"))
            & ((F.col("lb") < F.col("la")) | ((F.col("lb") == F.col("la")) & (F.col("b") < F.col("a"))))
            & (F.abs(F.col("at_a") - F.col("at_b")) <= F.col("edits")))
    found = spread_lookup(longer, shorter, ["rb", "token"]).where(fits).select("ra", "a", "rb", "b").distinct()
    similar = found.where(text_level(F.col("a"), F.col("b")) > 0)
    ways = F.filter(F.array(
        F.when(F.col("rb") >= F.col("ra"), F.struct(F.col("ra").alias("_rank"), F.col("a").alias("v"),
                                                    F.col("rb").alias("_rank_b"), F.col("b").alias("b"))),
        F.when(F.col("ra") >= F.col("rb"), F.struct(F.col("rb").alias("_rank"), F.col("b").alias("v"),
                                                    F.col("ra").alias("_rank_b"), F.col("a").alias("b")))),
        lambda w: w.isNotNull())
    oriented = similar.select(F.explode(ways).alias("w")).select("w.*", F.lit(1.0).alias("level"))
    return _identical(values).unionByName(oriented)

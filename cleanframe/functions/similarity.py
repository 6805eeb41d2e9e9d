"""Similarity of two values, 0 to 1. A missing value gives 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers up to OFFSET apart are equal, similarity falls to 0.5 over the next SCALE and on to 0
# over another; texts count as equal from TEXT_THRESHOLD on; dates with day and month swapped or with one of
# the easily confused months score DATE_SLIP.
NUMBER_OFFSET = 10.0
NUMBER_SCALE = 10.0
NUMBER_REACH = NUMBER_OFFSET + 2 * NUMBER_SCALE
TEXT_THRESHOLD = 0.75
DATE_SLIP = 0.5
CONFUSED_MONTHS = ((6, 7), (7, 6), (9, 10), (10, 9))


def exact_level(a: Column, b: Column) -> Column:
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def number_level(a: Column, b: Column) -> Column:
    beyond = F.greatest(F.abs(a.cast("double") - b.cast("double")) - NUMBER_OFFSET, F.lit(0.0))
    level = F.greatest(F.lit(0.0), 1.0 - beyond / (2 * NUMBER_SCALE))
    return F.when(a.isNull() | b.isNull() | F.isnan(level), 0.0).otherwise(level)


def date_level(a: Column, b: Column) -> Column:
    same_year = F.year(a) == F.year(b)
    slip = same_year & (F.month(a) == F.day(b)) & (F.day(a) == F.month(b))
    for one, other in CONFUSED_MONTHS:
        slip |= same_year & (F.day(a) == F.day(b)) & (F.month(a) == one) & (F.month(b) == other)
    return F.when(a == b, 1.0).when(slip, DATE_SLIP).otherwise(0.0)


def edit_distance(a: str, b: str, limit: int | None = None) -> int:
    """Damerau-Levenshtein distance without the restriction that a transposed pair is never edited again.

    With a limit only the band of cells that a distance within it can pass is filled; a larger distance comes out as any
    number above the limit."""
    last_row: dict[str, int] = {}
    far = len(a) + len(b) + 1
    band = max(len(a), len(b)) if limit is None else limit
    if abs(len(a) - len(b)) > band:
        return far
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        start, stop = max(1, i - band), min(len(b), i + band)
        row = [far, i if start == 1 else far, *[far] * (start - 1)]
        last_column = b.rfind(x, 0, start - 1) + 1
        above = table[i]
        for j, y in enumerate(b[start - 1:stop], start):
            swap_row, swap_column = last_row.get(y, 0), last_column
            best = min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1)
            if swap_row and swap_column:
                between = (i - swap_row - 1) + (j - swap_column - 1)
                best = min(best, table[swap_row][swap_column] + between + 1)
            row.append(best)
            if x == y:
                last_column = j
        table.append(row + [far] * (len(b) - stop))
        last_row[x] = i
    return table[-1][-1]


@F.pandas_udf(T.IntegerType())
def edit_distance_udf(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y, int(n)) for x, y, n in zip(a, b, limit)], dtype="Int32")


def allowed_edits(a: Column, b: Column) -> Column:
    return F.floor(F.greatest(F.length(a), F.length(b)) * (1 - TEXT_THRESHOLD)).cast("int")


def text_level(a: Column, b: Column) -> Column:
    """1 when the similarity 1 - distance / longer length reaches the threshold, else 0.

    The plain Levenshtein distance, computed in the JVM, bounds the wanted one from both sides (a transposition
    counts as two edits there); it gives up beyond twice the allowed edits, and only pairs between go through Python.
    """
    allowed = allowed_edits(a, b)
    plain = F.call_function("levenshtein", a, b, 2 * allowed)
    open_a = F.when(plain > allowed, a)
    exact = edit_distance_udf(open_a, F.when(open_a.isNotNull(), b), allowed)
    hit = F.when((plain >= 0) & (plain <= allowed), True).otherwise(F.coalesce(exact <= allowed, F.lit(False)))
    usable = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(usable & hit, 1.0).otherwise(0.0)

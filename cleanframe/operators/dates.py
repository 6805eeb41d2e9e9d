"""Parts of a timestamp as new columns named `<column> (<PART>)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import TIMESTAMP, kind, ref

# The parts, Sunday being day 0; date and time are text without trailing zeros of the fraction.
PARTS = {
    "DOW": lambda c: (F.dayofweek(c) - 1).cast("double"),
    "MONTH": lambda c: F.month(c).cast("double"),
    "YEAR": lambda c: F.year(c).cast("double"),
    "DATE": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "TIME": lambda c: F.regexp_replace(F.date_format(c, "HH:mm:ss.SSSSSS"), r"\.0+$|(\.\d*?[1-9])0+$", "$1"),
}


def extract_part(df: DataFrame, column: str, part: str) -> DataFrame:
    """DOW, MONTH, YEAR, DATE or TIME; an existing output column is overwritten."""
    part = part.upper()
    if part not in PARTS:
        raise ValueError(f"unknown part {part!r}; choose one of {', '.join(PARTS)}")
    if kind(df, column) != TIMESTAMP:
        raise ValueError(f"column {column!r} is {kind(df, column)}, a timestamp is needed")
    return df.withColumn(f"{column} ({part})", PARTS[part](ref(column)))

"""Add, drop, rename, retype and reorder columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import BIT, DOUBLE, INTEGER, REAL, TEXT, TIMESTAMP, friendly_type, kind, ref, require

# The five column types a user may choose.
USER_TYPES: dict[str, T.DataType] = {
    "INT": T.IntegerType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "VARCHAR(255)": T.StringType(),
    "BIT": T.BooleanType(),
}
# A date in month-day-year order, and its ISO form.
MONTH_FIRST = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
MONTH_FIRST_AS_ISO = "$3-$1-$2"


def user_type(name: str) -> T.DataType:
    try:
        return USER_TYPES[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown type {name!r}; choose one of {', '.join(USER_TYPES)}") from None


def add_column(df: DataFrame, name: str, type_name: str) -> DataFrame:
    """Add an all-NULL column; an existing name is left alone."""
    dtype = user_type(type_name)
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    new = new.replace('"', "")
    if not new.strip():
        raise ValueError("the new column name is empty")
    if new == old:
        raise ValueError("the new column name equals the old one")
    if new in df.columns:
        raise ValueError(f"column {new!r} exists already")
    return df.withColumnRenamed(old, new)


def parse_timestamp(text):
    """ISO or month-day-year; NULL when neither fits."""
    return F.regexp_replace(F.trim(text), MONTH_FIRST, MONTH_FIRST_AS_ISO).try_cast("timestamp_ntz")


def change_type(df: DataFrame, name: str, type_name: str) -> DataFrame:
    """Cast a column; one value that does not fit fails the whole operation."""
    target, source, c = user_type(type_name), kind(df, name), ref(name)
    wanted = friendly_type(target)
    if wanted == TEXT:
        cast = F.substring(c.cast("string"), 1, 255)
    elif wanted == INTEGER and source in (DOUBLE, REAL):
        cast = F.rint(c.cast("double")).cast(target)
    elif wanted == TIMESTAMP and source == TEXT:
        parsed = parse_timestamp(c)
        message = F.concat(F.lit(f"column {name}: not a timestamp: "), c)
        cast = F.coalesce(parsed, F.when(c.isNotNull(), F.raise_error(message).cast(target)))
    elif wanted == BIT and source == INTEGER:
        cast = c.bitwiseAND(F.lit(1)) == 1
    elif source in (TEXT, wanted) or {source, wanted} <= {INTEGER, DOUBLE, REAL} or (source, wanted) == (BIT, INTEGER):
        cast = c.cast(target)
    else:
        raise ValueError(f"cannot turn {source} column {name!r} into {wanted}")
    return df.withColumn(name, cast)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, folded type."""
    rows = [(i, f.name, friendly_type(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def id_first(df: DataFrame, id_col: str = "id") -> DataFrame:
    require(df, id_col)
    return df.select(ref(id_col), *[ref(c) for c in df.columns if c != id_col])

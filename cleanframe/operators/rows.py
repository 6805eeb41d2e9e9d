"""Row identity, insertion, deletion by id, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import TEXT, data_type, friendly_type, ref, require
from cleanframe.operators.schema import id_first
from cleanframe.plans.ordering import with_position

FILTER_IDS = 1_000


def assign_id(df: DataFrame, order_by: list[str], id_col: str = "id", start: int = 1) -> DataFrame:
    """Give rows a dense serial id in the order of `order_by`; the id column comes first."""
    require(df, *order_by)
    if id_col in df.columns:
        raise ValueError(f"column {id_col!r} exists already")
    return id_first(with_position(df, order_by, id_col, start), id_col)


def max_id(df: DataFrame, id_col: str = "id") -> int:
    """Largest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(ref(id_col)), F.lit(0)).cast("long")).first()[0]


def min_id(df: DataFrame, id_col: str = "id") -> int | None:
    return df.agg(F.min(ref(id_col))).first()[0]


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes NULL."""
    return df.select(*[
        F.when(ref(f.name) != "", ref(f.name)).alias(f.name) if friendly_type(f.dataType) == TEXT else ref(f.name)
        for f in df.schema.fields])


def conform(rows: DataFrame, target: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Cast `rows` to the columns of `target`; missing ones are NULL, unknown ones an error."""
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    given = blank_to_null(rows)
    return given.select(*[
        (ref(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields if f.name not in skip])


def insert_rows(df: DataFrame, values: list[dict], id_col: str = "id") -> DataFrame:
    """Append rows given as {column: value}; ids go on after the largest one."""
    if not values:
        return df
    names = sorted({k for row in values for k in row})
    if id_col in names:
        raise ValueError(f"{id_col!r} is assigned, not given")
    schema = ", ".join(["_n long"] + [f"_v{i} string" for i in range(len(names))])
    rows = [(n, *[None if row.get(k) is None else str(row[k]) for k in names]) for n, row in enumerate(values)]
    raw = df.sparkSession.createDataFrame(rows, schema)
    first = max_id(df, id_col) + 1
    named = raw.select(*[F.col(f"_v{i}").alias(k) for i, k in enumerate(names)],
                       (F.col("_n") + first).cast("string").alias(id_col))
    return df.unionByName(conform(named, df))


def append_rows(df: DataFrame, more: DataFrame, order_by: list[str], id_col: str = "id") -> DataFrame:
    """Append a table without ids; its rows are numbered on after the largest id."""
    extra = [c for c in order_by if c not in df.columns]
    first = max_id(df, id_col) + 1
    numbered = with_position(more, order_by, "_id", first).drop(*extra, id_col).withColumnRenamed("_id", id_col)
    return df.unionByName(conform(numbered, df))


def delete_ids(df: DataFrame, ids, id_col: str = "id") -> DataFrame:
    """Drop rows by id, given as a list or as the first column of a DataFrame. A NULL among the ids names no row.

    A list of up to FILTER_IDS ids is a filter that reaches the scan, a longer one an anti join; both drop the same rows."""
    require(df, id_col)
    if isinstance(ids, DataFrame):
        gone = ids.select(ref(ids.columns[0]).alias(id_col)).where(ref(id_col).isNotNull()).distinct()
        return df.join(gone, id_col, "left_anti").select(*[ref(c) for c in df.columns])
    given = [i for i in ids if i is not None]
    if len(given) <= FILTER_IDS:
        return df.where(~ref(id_col).isin(given) | ref(id_col).isNull()) if given else df
    return delete_ids(df, id_frame(df, given, id_col), id_col)


def id_frame(df: DataFrame, ids: list, id_col: str) -> DataFrame:
    """A list of ids as a table of the id's type, without None."""
    given = [(i,) for i in ids if i is not None]
    return df.sparkSession.createDataFrame(given, f"_id {data_type(df, id_col).simpleString()}")


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in the first column of `ids` (semi join)."""
    wanted = ids.select(ref(ids.columns[0]).alias(id_col)).distinct()
    return df.join(wanted, id_col, "left_semi").select(*[ref(c) for c in df.columns])


def copy_table(df: DataFrame, path: str) -> DataFrame:
    """Write a copy; refuse to overwrite."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)

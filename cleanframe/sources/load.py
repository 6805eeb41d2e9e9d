"""Choosing the reader by file extension."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cleanframe.sources.csv import append_csv, read_csv
from cleanframe.sources.dump import read_dump
from cleanframe.sources.zipped import read_zip

# File extensions that can be loaded.
EXTENSIONS = ("zip", "csv", "dump", "sql")


def extension(path: str) -> str:
    found = os.path.splitext(path)[1].lstrip(".").lower()
    if found not in EXTENSIONS:
        raise ValueError(f"cannot load {path!r}; choose a file ending in {', '.join(EXTENSIONS)}")
    return found


def load(spark: SparkSession, path: str, table: str | None = None, typed: bool = False,
         id_col: str | None = "id", existing: dict[str, DataFrame] | None = None, append: bool | None = None,
         multiline: bool | None = None) -> dict[str, DataFrame]:
    """Tables of a file by name; the default name is the file name without its extension.

    A CSV for one of the `existing` tables is appended to it, any other makes a new table. `append` asks for either and is
    an error if the table is missing or there already. Archives and dumps only make new tables.
    """
    existing = existing or {}
    kind = extension(path)
    table = table or os.path.splitext(os.path.basename(path))[0]
    if kind == "csv":
        if append and table not in existing:
            raise ValueError(f"no such table: {table}")
        if table in existing and append is not False:
            return {table: append_csv(existing[table], path, id_col or "id", multiline)}
        made = {table: read_csv(spark, path, typed, id_col, multiline)}
    else:
        if append:
            raise ValueError("only a CSV file can be appended")
        made = read_zip(spark, path, typed, id_col) if kind == "zip" else read_dump(spark, path, table, id_col)
    there = sorted(set(made) & set(existing))
    if there:
        raise ValueError(f"tables exist already: {', '.join(there)}")
    return made

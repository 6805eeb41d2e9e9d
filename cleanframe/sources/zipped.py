"""ZIP archives of CSV files."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.sources.csv import finish

BATCH_ROWS = 10_000
ORDER = ["_archive", "_member", "_line"]


def _open(uri: str):
    """A seekable stream on the shared file system."""
    if uri.startswith("file:/"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_file(path)


def _csv_rows(archive: zipfile.ZipFile, member: str):
    return csv.reader(io.TextIOWrapper(archive.open(member), "utf-8-sig", newline=""))


def _headers(batches):
    """One row per CSV member: (archive, position, member, table name, column names)."""
    for batch in batches:
        for uri in batch["path"]:
            with _open(uri) as stream, zipfile.ZipFile(stream) as archive:
                members = [m.filename for m in archive.infolist() if m.filename.endswith(".csv")]
                yield pd.DataFrame({
                    "archive": uri, "position": range(len(members)), "member": members,
                    "table": [m.split(".csv")[0].split("/")[-1] for m in members],
                    "columns": [next(_csv_rows(archive, m), []) for m in members]})


def _reader(columns: list[str]):
    """Stream the rows of members in bounded batches, values placed by header name."""
    def read(batches):
        for batch in batches:
            for uri, position, member in zip(batch["archive"], batch["position"], batch["member"]):
                with _open(uri) as stream, zipfile.ZipFile(stream) as archive:
                    lines = _csv_rows(archive, member)
                    header = next(lines, [])
                    place = [header.index(c) if c in header else None for c in columns]
                    block = []
                    for number, line in enumerate(lines):
                        if any(line[len(header):]):
                            raise ValueError(f"{member}: a row has more values than the header")
                        if line:
                            block.append((uri, position, number, *[
                                line[i] if i is not None and i < len(line) else None for i in place]))
                        if len(block) == BATCH_ROWS:
                            yield pd.DataFrame(block, columns=[*ORDER, *columns])
                            block = []
                    if block:
                        yield pd.DataFrame(block, columns=[*ORDER, *columns])
    return read


def read_zip(spark: SparkSession, path: str, typed: bool = False, id_col: str | None = "id") -> dict[str, DataFrame]:
    """One table per base name of the CSV members; members with the same name are appended.

    Each member is streamed by its own task, so memory does not grow with its size. Only member names and
    headers reach the driver.
    """
    archives = spark.read.format("binaryFile").load(path).select("path")
    listing = archives.mapInPandas(
        _headers, "archive string, position long, member string, table string, columns array<string>")
    tables: dict[str, list] = {}
    for row in sorted(listing.collect(), key=lambda r: (r["archive"], r["position"])):
        if row["columns"]:
            tables.setdefault(row["table"], []).append(row)
    result = {}
    for name, members in tables.items():
        columns = [c.replace('"', "") for c in members[0]["columns"]]
        for m in members:
            unknown = set(m["columns"]) - set(columns)
            if unknown:
                raise ValueError(f"{m['member']}: no such column: {', '.join(sorted(unknown))}")
        parts = spark.createDataFrame([(m["archive"], m["position"], m["member"]) for m in members],
                                      "archive string, position long, member string").repartition(len(members), "archive", "position")
        fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
        text = parts.mapInPandas(_reader(columns), f"_archive string, _member long, _line long, {fields}")
        result[name] = finish(text, typed, ORDER, id_col)
    return result

"""The raw version and named snapshots of a table, kept as Parquet folders with a manifest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Most snapshots per table, and the time stamp in their names.
SNAPSHOT_LIMIT = 10
NAME_TIME = "%Y%m%d%H%M%S"
EVENTS = "name string, version long, note string, at timestamp_ntz, event string"
RAW = "raw"


class VersionStore:
    """Versions below one folder. Data is written first, then its manifest row: a failed write stays invisible."""

    def __init__(self, spark: SparkSession, folder: str, limit: int = SNAPSHOT_LIMIT):
        self.spark, self.folder, self.limit = spark, folder.rstrip("/"), limit

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def _events(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/manifest")

    def _record(self, name: str, version: int, note: str | None, at: dt.datetime, event: str) -> None:
        row = self.spark.createDataFrame([(name, version, note, at, event)], EVENTS)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _alive(self) -> DataFrame:
        events = self._events()
        deleted = events.where("event = 'delete'").select("version")
        return events.where("event = 'write'").join(deleted, "version", "left_anti")

    def _find(self, name: str) -> Row:
        found = self._alive().where(F.col("name") == name).first()
        if found is None:
            raise ValueError(f"no such snapshot: {name}")
        return found

    def _version_of(self, name: str) -> int:
        return self._find(name)["version"]

    def write_raw(self, df: DataFrame, at: dt.datetime | None = None) -> DataFrame:
        """Version 0, written once."""
        df.write.mode("errorifexists").parquet(self._path(0))
        self._record(RAW, 0, None, at or dt.datetime.now(), "write")
        return self.raw()

    def raw(self) -> DataFrame:
        return self.spark.read.parquet(self._path(0))

    def snapshot(self, df: DataFrame, note: str = "", at: dt.datetime | None = None) -> str:
        """Write a snapshot and return its name; an error when the limit is reached or the second is taken."""
        at = at or dt.datetime.now()
        if self.snapshots().count() >= self.limit:
            raise ValueError(f"there are {self.limit} snapshots already; delete one first")
        name = f"backup_{at.strftime(NAME_TIME)}"
        if not self._alive().where(F.col("name") == name).isEmpty():
            raise ValueError(f"snapshot {name} exists already")
        newest = self._events().agg(F.max("version")).first()[0]
        version = (0 if newest is None else newest) + 1
        df.write.mode("errorifexists").parquet(self._path(version))
        self._record(name, version, note, at, "write")
        return name

    def snapshots(self) -> DataFrame:
        """(name, version, note, at) of the snapshots that are not deleted."""
        return self._alive().where(F.col("name") != RAW).select("name", "version", "note", "at").orderBy("version")

    def note(self, name: str) -> str:
        return self._find(name)["note"]

    def restore(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(self._version_of(name)))

    def taken_at(self, name: str) -> dt.datetime:
        return self._find(name)["at"]

    def delete(self, name: str, at: dt.datetime | None = None) -> None:
        """Mark a snapshot deleted, then free its files."""
        version = self._version_of(name)
        self._record(name, version, None, at or dt.datetime.now(), "delete")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(version))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

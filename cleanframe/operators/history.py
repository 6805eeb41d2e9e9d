"""The action log: (action_id, table, date, action_desc, undone), one row per change of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanframe.operators.page import page
from cleanframe.operators.predicates import like_anywhere
from cleanframe.plans.skew import spread_lookup
from cleanframe.plans.storage import cut_lineage

# Fixed value: undoable actions kept per table.
HISTORY_LIMIT = 20
LOG = "action_id long, table string, date timestamp_ntz, action_desc string, undone boolean"


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def close_old_actions(log: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Of each table's open actions only the newest `limit` stay open; a limit of 0 closes nothing.

    The rank filter lets Spark keep `limit` rows per table and task before the shuffle, so a table with most of
    the log does not gather in one task.
    """
    if limit < 0:
        raise ValueError("the limit must not be negative")
    if limit == 0:
        return log
    newest_first = Window.partitionBy("table").orderBy(F.desc("action_id"))
    newest = log.where(~F.col("undone")).select("table", "action_id").withColumn(
        "_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= limit)
    oldest_open = newest.groupBy("table").agg(F.min("action_id").alias("_from"))
    return (spread_lookup(log, oldest_open, ["table"], "left")
            .withColumn("undone", F.col("undone") | (F.col("action_id") < F.col("_from")))
            .select(*log.columns))


def log_action(log: DataFrame, table: str, desc: str, at: dt.datetime | None = None,
               limit: int = HISTORY_LIMIT) -> DataFrame:
    """The log with one more action under the next id, what is over the limit closed. For a log that lasts see ActionLog."""
    last = log.agg(F.max("action_id")).first()[0] or 0
    row = log.sparkSession.createDataFrame([(last + 1, table, at or dt.datetime.now(), desc, False)], LOG)
    return cut_lineage(close_old_actions(log.unionByName(row), limit))


class ActionLog:
    """A log in a folder. Each action and each undo appends one small file; which actions are open follows when it is read."""

    def __init__(self, spark: SparkSession, folder: str, limit: int = HISTORY_LIMIT):
        if limit < 0:
            raise ValueError("the limit must not be negative")
        self.spark, self.folder, self.limit = spark, folder, limit

    def _written(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return empty_log(self.spark)
        return self.spark.read.schema(LOG).parquet(self.folder)

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(self.folder)

    def add(self, table: str, desc: str, at: dt.datetime | None = None) -> int:
        """Append an action and return its id."""
        last = self._written().agg(F.max("action_id")).first()[0] or 0
        self._append(last + 1, table, at or dt.datetime.now(), desc, False)
        return last + 1

    def undo(self, action_id: int) -> None:
        """Close an open action; an error for any other."""
        mark_undone(self.read(), action_id)
        self._append(action_id, None, None, None, True)

    def read(self) -> DataFrame:
        """The actions; an undone one and those over the limit are closed."""
        written = self._written()
        undone = written.where("table IS NULL").select("action_id").distinct()
        own = written.where("table IS NOT NULL")
        marked = own.join(undone.withColumn("_gone", F.lit(True)), "action_id", "left").select(
            *[(F.col("undone") | F.coalesce("_gone", F.lit(False))).alias("undone") if c == "undone" else F.col(c) for c in own.columns])
        return close_old_actions(marked, self.limit)


def actions(log: DataFrame, table: str, text: str | None = None, offset: int = 0, limit: int | None = None,
            column: str | None = None, ascending: bool = True) -> DataFrame:
    """A page of a table's actions whose description contains `text`; only the newest open one is undoable."""
    own = log.where(F.col("table") == table)
    newest = own.where(~F.col("undone")).agg(F.max("action_id")).first()[0]
    listed = own.where(like_anywhere(F.col("action_desc"), text)) if text else own
    listed = listed.withColumn("is_undoable", F.coalesce(F.col("action_id") == F.lit(newest).cast("long"), F.lit(False)))
    return page(listed, offset, limit, column, ascending, "action_id").select(
        "date", "action_desc", "action_id", "undone", "is_undoable")


def mark_undone(log: DataFrame, action_id: int) -> DataFrame:
    """Close an open action; an error for any other."""
    if log.where((F.col("action_id") == action_id) & ~F.col("undone")).isEmpty():
        raise ValueError(f"action {action_id} cannot be undone")
    return log.withColumn("undone", F.col("undone") | (F.col("action_id") == action_id))


def keep_until(log: DataFrame, table: str, at: dt.datetime) -> DataFrame:
    """After restoring a snapshot: drop the table's actions newer than it."""
    return log.where((F.col("table") != table) | (F.col("date") <= F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")))


def keep_first(log: DataFrame, table: str) -> DataFrame:
    """After reverting to the raw version: keep only the table's first action."""
    first = log.where(F.col("table") == table).agg(F.min("action_id")).first()[0]
    return log if first is None else log.where((F.col("table") != table) | (F.col("action_id") == first))

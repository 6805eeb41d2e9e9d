"""The shared folder: reliable checkpoints and intermediate tables live here."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, else the context's checkpoint folder.

    Only a local session without either gets a temporary folder; on a cluster that is an error, since a
    machine-local path is lost with its machine.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="cleanframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back: for a result that several passes read, each of
    them just some of its columns."""
    folder = new_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one computation in a folder of their own. Those no longer needed go at once, the others with `clear`."""

    def __init__(self, spark: SparkSession, label: str = "scratch"):
        self.spark, self.root = spark, new_folder(spark, label)
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it back."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that `put` has made. What reads them must be written by then."""
        for table in tables:
            _delete(self.spark, self.paths.pop(id(table))[1])
        # Shuffle files stay until the driver finds that nothing refers to them.
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but those that a result still to be read needs."""
        kept = {id(table) for table in keep}
        self.drop(*[table for key, (table, _) in self.paths.items() if key not in kept])


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

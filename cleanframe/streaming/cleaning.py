"""Running the row-wise operators on a stream.

Operators that need a statistic are used through their fitted form: `fit` on a table, then the row-wise part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cleanframe.plans.storage import new_folder

Step = Callable[[DataFrame], DataFrame]


def read_stream(spark: SparkSession, pattern: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files matching a path pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def apply_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = step(df)
    return df


def run_available(stream: DataFrame, folder: str | None = None, output_mode: str = "append") -> DataFrame:
    """Process everything available, then stop. The result and the progress are kept in the shared folder, so a
    restart with the same folder goes on where it stopped and writes each row once."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "stream")
    query = (stream.writeStream.format("parquet").outputMode(output_mode).option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

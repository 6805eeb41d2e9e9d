"""Helpers shared by the operators on texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_CHARS = 3_000_000
WORD = r"[^\x20\x09-\x0D]+"
LETTERS = re.compile(r"[^\W\d_]+")


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folds(doc_id: Column, divisor: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `limit` bytes of text each, so that work on one part is bounded by that or by
    the longest text."""
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Return what Arrow keeps of freed buffers: workers outlive their tasks, and their executor's memory is one budget."""
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, text: str, schema: str | T.StructType,
              work: Callable[[], Callable[[pa.RecordBatch], dict]], done: Callable[[], None] | None = None,
              limit: int = SLICE_CHARS) -> DataFrame:
    """Run `work()` once per task and what it returns on slices of the task's rows, bounded by `limit`. It gives a dict of columns. `done()`
    runs at the end of a task, to let go of what the worker would hold while it runs tasks of other stages."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        try:
            for batch in batches:
                for part in text_slices(batch, text, limit):
                    got = step(part)
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=False) for f in out],
                                                     schema=out)
        finally:
            if done:
                done()
            release()

    return df.mapInArrow(run, fields)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

"""Token counts per document from flat token files that have no index.

A file is nothing but ids of a fixed width, with one id ending each document. Files are cut into blocks of equal size, wherever
that falls; one vectorised comparison per block finds its separators. What a block must know of those before it, the number of
separators and the place of the last one, is a running sum and a running maximum, so an exclusive prefix scan over block
summaries stitches documents that cross blocks. The scan has two levels, so no task sees more than `FAN` blocks of a file or
the sums of as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import map_texts
from cleanframe.llm.tokens import encoder
from cleanframe.plans.storage import stored

END = 50_256
BLOCK_TOKENS = 1 << 20
FAN = 4_096


def write_tokens(docs: DataFrame, path: str, folder: str, text: str = "text", end: int = END) -> None:
    """Write the ids of all documents as flat files of little-endian unsigned 16-bit ids, `end` after each document.

    A NULL or empty text is the end alone. Spark's text writer puts the bytes of a row down as they are, and its line separator is
    the end's two bytes.
    """

    def step(batch: pa.RecordBatch) -> dict:
        flat, sizes = encoder(path).encode(batch.column("_text").to_pylist(), end)
        if len(flat) and flat.max() > 0xFFFF:
            raise ValueError("an id does not fit into 16 bits")
        raw = flat.astype("<u2").tobytes()
        ends = 2 * np.cumsum(sizes)
        return {"ids": [raw[b - 2 * n:b - 2] for b, n in zip(ends.tolist(), sizes.tolist())]}

    rows = map_texts(docs.select(ref(text).alias("_text")), "_text", "ids binary", lambda: step)
    separator = end.to_bytes(2, "little").decode("latin-1")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", separator).text(folder)


def blocks_of(spark: SparkSession, folder: str, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, bytes, size): the blocks of the files in a folder; only names and lengths are read."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / F.lit(width * block)))).alias("block"))
    return blocks.repartition(F.col("file"), F.col("block"))


def separators(blocks: DataFrame, end: int = END, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, ends): the places in the file of the ends in each block."""
    kind = {1: "u1", 2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                if one["bytes"] % width:
                    raise ValueError(f"{one['file']}: {one['bytes']} bytes are no whole number of ids")
                name = one["file"] if "://" in one["file"] or not one["file"].startswith("file:") else "file://" + one["file"][5:]
                system, path = pyarrow.fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(width * block, one["block"] * width * block), kind)
                ends = np.flatnonzero(ids == end) + one["block"] * block
                yield pa.RecordBatch.from_arrays([pa.array([one["file"]]), pa.array([one["block"]], pa.int64()),
                                                  pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                                                 names=["file", "block", "tokens", "ends"])

    return blocks.select("file", "block", "bytes").mapInArrow(run, "file string, block long, tokens long, ends array<long>")


def count_tokens(found: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, document, start, n_tokens, closed) from the separators of blocks.

    `document` counts from 0 within its file; `start` is the place of its first id. Two ends in a row hold an empty document.
    Ids after the last end are a document that is not closed. An empty file has no documents. `found` is read twice.
    """
    last = F.element_at("ends", -1)
    sums = found.select("file", "block", "tokens", F.size("ends").cast("long").alias("n"),
                        F.when(F.size("ends") > 0, last).alias("last"), F.floor(F.col("block") / fan).alias("part"))
    inner = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sums.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
             .select("file", "part", F.sum("n").over(outer).alias("n_parts"), F.max("last").over(outer).alias("last_parts")))
    scanned = (sums.select("file", "block", "part", F.sum("n").over(inner).alias("n_blocks"), F.max("last").over(inner).alias("last_blocks"))
               .join(parts, ["file", "part"])
               .select("file", "block", (F.coalesce("n_blocks", F.lit(0)) + F.coalesce("n_parts", F.lit(0))).alias("before"),
                       F.coalesce(F.greatest("last_blocks", "last_parts"), F.lit(-1)).alias("previous")))
    closed = (found.join(scanned, ["file", "block"])
              .select("file", "before", "ends", "previous", F.posexplode("ends").alias("i", "end"))
              .withColumn("start", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("previous")) + 1)
              .select("file", (F.col("before") + F.col("i")).alias("document"), "start",
                      (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed")))
    rest = (sums.groupBy("file").agg(F.sum("n").alias("document"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"),
                                     F.sum("tokens").alias("tokens")).where("tokens > start")
            .select("file", "document", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))
    return closed.unionByName(rest)


def token_counts(spark: SparkSession, folder: str, end: int = END, width: int = 2, block: int = BLOCK_TOKENS,
                 fan: int = FAN) -> DataFrame:
    """The token counts of the documents in the flat files of a folder."""
    return count_tokens(stored(separators(blocks_of(spark, folder, width, block), end, width, block)), fan)

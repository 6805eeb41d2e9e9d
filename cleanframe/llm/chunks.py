"""Repeated passages by content-defined chunks.

A gear hash over the last 32 bytes decides where a text is cut, so equal passages are cut alike wherever they stand, and an
insertion changes only the chunks around it. A chunk ends where the hash's upper bits are zero, at least `SHORTEST` and at most
`LONGEST` bytes after the last cut. Chunks are compared by a 128-bit digest: one that several documents hold stays in the
document with the smallest id. Neighbouring repeated chunks are joined, and spans of at least `LEAST_WORDS` words reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import map_texts, mix, unused

SHORTEST, LONGEST, BITS = 16, 256, 5
LEAST_WORDS = 12
REACH = 32
#: The gear of each byte. Zero bytes stand between texts and have none, so a hash never reaches into another text.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
GEAR[0] = 0
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Places after which the gear hash allows a cut. h(i) is the sum of gear(byte i - j) << j, doubled up in five steps."""
    rolled = GEAR[raw]
    reach = 1
    while reach < REACH:
        shifted = np.zeros_like(rolled)
        shifted[reach:] = rolled[:-reach] << np.uint32(reach)
        rolled = rolled + shifted
        reach *= 2
    return np.flatnonzero(rolled >> np.uint32(32 - BITS) == 0) + 1


def chunk_texts(texts: list[str | None]) -> dict:
    """(row, seq, start, end, words, high, low) of all chunks: places in code points, words that begin in the chunk, digest."""
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    gap = bytes(REACH)
    joined = gap + gap.join(encoded) + gap
    raw = np.frombuffer(joined, np.uint8)
    starts = np.cumsum([REACH] + [len(e) + REACH for e in encoded])[:-1]
    # A cut inside a character moves to its end.
    inside = (raw & 0xC0) == 0x80
    allowed = boundaries(raw)
    while len(allowed) and (moved := inside[np.minimum(allowed, len(raw) - 1)]).any():
        allowed = allowed + moved
    allowed = np.unique(allowed)
    rows, sequence, cuts_a, cuts_b = [], [], [], []
    edges = np.searchsorted(allowed, np.column_stack([starts, starts + [len(e) for e in encoded]]), side="right")
    for row, (begin, (a, b)) in enumerate(zip(starts.tolist(), edges.tolist())):
        end, last, cuts = begin + len(encoded[row]), begin, []
        for cut in [*allowed[a:b].tolist(), end]:
            while cut - last > LONGEST:
                last += LONGEST
                while inside[last]:
                    last += 1
                cuts.append(last)
            if cut - last >= SHORTEST or cut == end > last:
                cuts.append(cut)
                last = cut
        if cuts:
            rows.append(np.full(len(cuts), row))
            sequence.append(np.arange(len(cuts)))
            cuts_a += [begin, *cuts[:-1]]
            cuts_b += cuts
    if not rows:
        empty = np.zeros(0, np.int64)
        return dict.fromkeys(["row", "seq", "start", "end", "words", "high", "low"], empty)
    row = np.concatenate(rows)
    points = np.append(0, np.cumsum(~inside))
    blank = BLANK[raw] | (raw == 0)
    begun = np.append(0, np.cumsum(~blank & np.append(True, blank[:-1])))
    first, after = np.array(cuts_a), np.array(cuts_b)
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(cuts_a, cuts_b)]), ">i8").reshape(-1, 2)
    origin = points[starts][row]
    return {"row": row, "seq": np.concatenate(sequence), "start": points[first] - origin, "end": points[after] - origin,
            "words": begun[after] - begun[first], "high": digest[:, 0].astype(np.int64), "low": digest[:, 1].astype(np.int64)}


def chunked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seq, start, end, words, high, low) of the chunks of all documents with an id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        found = chunk_texts(batch.column("_text").to_pylist())
        ids = batch.column("_id").take(pa.array(found.pop("row")))
        return {"doc_id": ids, **found}

    named = docs.where(ref(id_col).isNotNull()).select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    return map_texts(named, "_text", f"doc_id {kind}, seq int, start int, end int, words int, high long, low long", lambda: step)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, words, chunks, is_first, first_doc_id): spans of chunks that other documents hold too.

    `is_first` marks the spans that stay: those of the smallest id. first_doc_id is the smallest such id for a span that goes.
    Places are code points, the end exclusive. Documents without a repeated span give no row. NULL and empty texts have no
    chunks; rows without id are left out; rows with equal id count as one document, whose texts are all searched.
    """
    chunks = chunked(docs, id_col, text)
    shared = (chunks.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .where("first != last").select("high", "low", "first"))
    found = (chunks.join(shared, ["high", "low"]).select("doc_id", "seq", "start", "end", "words", "first")
             .withColumn("is_first", F.col("doc_id") == F.col("first")).distinct())
    runs = found.withColumn("run", F.col("seq") - F.dense_rank().over(
        Window.partitionBy("doc_id", "is_first").orderBy("seq")))
    return (runs.groupBy("doc_id", "is_first", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
                 F.count("*").alias("chunks"), F.min("first").alias("first_doc_id"))
            .where(F.col("words") >= least_words)
            .select("doc_id", "start", "end", "words", "chunks", "is_first", "first_doc_id"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, less the spans that a document with a smaller id keeps."""
    key, gone = unused(docs, "_key"), unused(docs, "_spans")
    spans = (repeated_spans(docs, id_col, text).where("NOT is_first").groupBy(F.col("doc_id").alias(key))
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(gone)))

    def step(state, span):
        gap = F.substring(ref(text), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    left = F.aggregate(gone, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(
        s["out"], F.substring(ref(text), s["at"] + 1, F.char_length(ref(text)))))
    joined = docs.join(spans, ref(id_col) == F.col(key), "left")
    return joined.select(*[F.when(F.col(gone).isNull(), ref(c)).otherwise(left).alias(c) if c == text else ref(c)
                           for c in docs.columns])

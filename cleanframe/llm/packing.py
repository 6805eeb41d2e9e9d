"""Pack token pieces into sequences of a fixed capacity: dominance reduction, then best fit.

Both work on the number of pieces of each length, which are at most `capacity` numbers however large the corpus is.
The plan is a list of patterns (lengths that share a sequence, how many such sequences). Pieces are numbered within
their length by a distributed rank, and the rank alone says which sequence and which offset a piece gets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import ref
from cleanframe.llm.common import gather, map_texts
from cleanframe.llm.tokens import encoder
from cleanframe.plans.storage import stored

CAPACITY = 1024
END = 2
#: Ids take several times the room of their text while they are put together.
ENCODED_CHARS = 500_000


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int = END,
                 capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): the little-endian unsigned 32-bit ids of each document, ended by `end`.

    A document of more than `capacity` ids is cut so that only its first piece may be shorter. A NULL or empty text is the
    end alone. Rows that repeat an id or a whole row, and NULL ids, are documents of their own. No rows give no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            flat, sizes = encoder(path, special=True).encode(batch.column("_text").to_pylist(), end)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = gather(np.zeros(len(sizes), np.int64), pieces)
            first = sizes - (pieces - 1) * capacity
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            length = np.where(number == 0, first[row], capacity)
            begin = (np.cumsum(sizes) - sizes)[row] + start
            raw = flat.astype("<u4").tobytes()
            return {"doc_id": batch.column("_id").take(pa.array(row)), "piece": number.astype(np.int32), "start": start,
                    "length": length, "ids": [raw[4 * a:4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]}

        return step

    named = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    return map_texts(named, "_text", f"doc_id {kind}, piece int, start long, length long, ids binary", work,
                     lambda: encoder(path, special=True).clear(), ENCODED_CHARS)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets of at most three lengths that dominate every other set with the same largest length.

    A set dominates another if the other's lengths can be exchanged for parts of it without overfilling it, so some best
    packing holds it. For the largest length j, with k the largest that fits beside it:
    {j} if nothing fits beside j; {j, k} if no two others that fit beside j are together longer than k; {j, k, b} if at
    most two fit beside j and the shorter of any two such is at most b, the largest that fits beside j and k.
    Returns (fixed patterns, remaining counts).
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in sorted(left, reverse=True):
        while left.get(j, 0) > 0:
            pattern = _dominating(left, j, capacity)
            if pattern is None:
                break
            need = Counter(pattern)
            times = min(left[s] // n for s, n in need.items())
            fixed.append((pattern, times))
            for s, n in need.items():
                left[s] -= n * times
                if not left[s]:
                    del left[s]
    return fixed, left


def _dominating(left: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    rest = Counter(left)
    rest[j] -= 1
    beside = sorted((s for s, n in rest.items() if n > 0 and s <= room), reverse=True)
    if not beside:
        return (j,)
    k = beside[0]
    if k == room:
        return j, k
    small = [s for s in reversed(beside) for _ in range(min(rest[s], 3))][:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return j, k
    if len(small) > 2 and sum(small) <= room:
        # Three or more may fit: only a pair that leaves no more room than the smallest piece's fraction is safe to fix.
        return (j, k) if _best_sum(rest, beside, room) <= k else None
    pairs = [(a, b) for i, a in enumerate(beside) for b in beside[i:] if a + b <= room and (a != b or rest[a] > 1)]
    if max(a + b for a, b in pairs) <= k:
        return j, k
    partners = [b for a, b in pairs if a == k] + [a for a, b in pairs if b == k]
    if partners and all(b <= max(partners) for _, b in pairs):
        return j, k, max(partners)
    return None


def _best_sum(rest: Counter, beside: list[int], room: int) -> int:
    """The largest sum of any of the lengths that is at most `room`."""
    reachable = 1
    mask = (1 << (room + 1)) - 1
    for s in beside:
        for _ in range(min(rest[s], room // s)):
            grown = reachable | (reachable << s) & mask
            if grown == reachable:
                break
            reachable = grown
        if reachable >> room & 1:
            return room
    return reachable.bit_length() - 1


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: a length goes where the least room stays, as often as it fits there."""
    groups: dict[int, list[list]] = {capacity: []}
    for s in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        n = counts[s]
        for room in sorted(r for r in groups if r >= s and groups[r]):
            q, waiting = room // s, groups.pop(room)
            while waiting and n:
                pattern, bins = waiting.pop()
                whole = min(bins, n // q)
                if whole:
                    groups.setdefault(room - q * s, []).append([pattern + (s,) * q, whole])
                    n -= whole * q
                if whole < bins:
                    rest = bins - whole
                    if n:
                        groups.setdefault(room - n * s, []).append([pattern + (s,) * n, 1])
                        n, rest = 0, rest - 1
                    if rest:
                        waiting.append([pattern, rest])
            if waiting:
                groups.setdefault(room, []).extend(waiting)
            if not n:
                break
        q = capacity // s
        if n // q:
            groups.setdefault(capacity - q * s, []).append([(s,) * q, n // q])
        if n % q:
            groups.setdefault(capacity - n % q * s, []).append([(s,) * (n % q), 1])
    return [(tuple(p), n) for group in groups.values() for p, n in group]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, number of such sequences) that hold each length as often as counted."""
    too_long = [s for s in counts if not 0 < s <= capacity]
    if too_long:
        raise ValueError(f"lengths outside 1 to {capacity}: {too_long[:3]}")
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """`pieces` with sequence_id and offset. `order` names columns that tell pieces apart.

    Read three times, so hand in a stored table. Numbering is spread over hash buckets within each length, since one
    length (full pieces) may hold most rows. What the driver holds is a count per length, at most `capacity` of them.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(ref(length)).count().collect()}
    table = _places(plan_sequences(counts, capacity))
    buckets = 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*[ref(c) for c in order]), F.lit(buckets)))
    sums = salted.groupBy(ref(length).alias("_length"), "_bucket").agg(F.count("*").alias("_n"))
    before = sums.select("_length", "_bucket", (F.sum("_n").over(
        Window.partitionBy("_length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    numbered = salted.withColumn("_row", F.row_number().over(
        Window.partitionBy(ref(length), "_bucket").orderBy(*[ref(c) for c in order])))
    ranked = (numbered.join(before, (ref(length) == F.col("_length")) & (numbered["_bucket"] == before["_bucket"]))
              .select(*[numbered[f"`{c}`"] for c in pieces.columns], (F.col("_before") + F.col("_row") - 1).alias("_rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = _find(table, batch.column(length).to_numpy(), batch.column("_rank").to_numpy())
            kept = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType(fields))


def _places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), sorted by length and rank."""
    used: Counter = Counter()
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for s, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((s, used[s], n, base, offset))
            used[s] += n * times
            offset += n * s
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _find(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = int(max(table[:, 1].max(initial=0), rank.max(initial=0))) + 1
    row = table[np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, side="right") - 1]
    place = rank - row[:, 1]
    return row[:, 3] + place // row[:, 2], row[:, 4] + place % row[:, 2] * length


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of each sequence, in order; at most `capacity` pieces meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int = END,
                   capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents; empty for no documents."""
    pieces = token_pieces(docs, path, id_col, text, end, capacity)
    narrow = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(narrow, ["doc_id", "piece", "start", "ids_crc32"], capacity)

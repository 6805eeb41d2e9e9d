"""Near copies by a multi-index Hamming join of MinHash signatures.

A document is the set of its distinct k-word shingles; two link when den * |A and B| >= num * |A or B|. Its signature holds `HASHES`
values of b = 16 bits, each from the smallest of the shingles under one hash function. Two sets differ in a value with probability
1 - J, so the distance of two signatures (in how many values they differ) is about HASHES (1 - J).

The signature is split into `CHUNKS` chunks. If two differ in at most `RADIUS` values, some chunk differs in at most
`ERRORS` = RADIUS // CHUNKS of its own, by the pigeonhole principle. So each chunk is listed once for each choice of `ERRORS` values
to leave out, as (chunk, left out, remaining values), and every pair within the radius meets in one of these buckets. Pairs that meet
and lie within the radius are verified on their full sets, unless counts of their shingles by group show that they share too few. At
J = 0.85 a pair lies beyond the radius of 23 of 60 with probability 2.3e-6, and above that less often; none within it is missed.

Equal sets are one node, so exact copies cost nothing. How buckets are worked off without listing their pairs stands in `linking`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import mix
from cleanframe.llm.linking import (CHUNK_PAIRS, Close, Compare, Linker, Nodes, bounded_batches, buckets, bytes_of, described, groups_of,
                                    sets_of)
from cleanframe.llm.shingles import ODD, Rule, count_codes, overlap_bound
from cleanframe.plans.storage import Scratch

HASHES, CHUNKS, RADIUS = 60, 12, 23
ERRORS = RADIUS // CHUNKS
WIDTH = HASHES // CHUNKS
#: Odd factors: the order of products modulo 2^64 is another one for each.
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of `HASHES` 16-bit values per set; no set may be empty."""
    out = np.empty((len(sets), HASHES), np.uint16)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for k, factor in enumerate(FACTORS):
            out[:, k] = mix(np.minimum.reduceat(flat * factor, starts)) & np.uint64(0xFFFF)
    return out


def _code(sets: list[np.ndarray]) -> list[bytes]:
    """The signature and, behind it, the counts that bound an overlap."""
    return [row.tobytes() + counts for row, counts in zip(signatures(sets), count_codes(sets))]


def _values(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes[:, :2 * HASHES]).view("<u2")


LEFT_OUT = list(combinations(range(WIDTH), ERRORS))


def bucket_keys(values: np.ndarray) -> np.ndarray:
    """For each signature its buckets: the number of (chunk, values left out) in the highest byte, then a hash of the remaining values."""
    out = np.empty((len(values), CHUNKS * len(LEFT_OUT)), np.uint64)
    values = values.astype(np.uint64) + np.uint64(1)
    for number in range(out.shape[1]):
        chunk, errors = number // len(LEFT_OUT), LEFT_OUT[number % len(LEFT_OUT)]
        key = np.full(len(values), number + 1, np.uint64)
        for at in range(WIDTH):
            if at not in errors:
                key = mix(key * ODD + values[:, chunk * WIDTH + at])
        out[:, number] = np.uint64(number) << np.uint64(56) | key >> np.uint64(8)
    return out.view(np.int64)


def within_radius(rule: Rule) -> Close:
    """Whether signatures lie within the radius and counts allow a link."""

    def close(n: np.ndarray, codes: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
        keep = (_values(codes) != _values(others)).sum(axis=1) <= RADIUS
        at = np.flatnonzero(keep)
        keep[at] = overlap_bound(codes[at, 2 * HASHES:], others[at, 2 * HASHES:]) >= rule.needed(n[at] + m[at])
        return keep

    return close


def compare_signatures(rule: Rule) -> Compare:
    """Compares two blocks of a bucket, but for the pairs that meet in an earlier bucket too, as most pairs of a large group do: those with an equal
    earlier chunk, or with equal values at the places that this bucket leaves out, where it is not the chunk's first."""
    close = within_radius(rule)

    def compare(n: np.ndarray, codes: np.ndarray, component: np.ndarray, side: np.ndarray, key: int) -> Iterator[np.ndarray]:
        values, number = _values(codes), key >> 56
        chunk, errors = number // len(LEFT_OUT), LEFT_OUT[number % len(LEFT_OUT)]
        names = []
        for c in range(chunk):
            name = np.full(len(n), 1, np.uint64)
            for at in range(WIDTH):
                name = mix(name * ODD + values[:, c * WIDTH + at])
            names.append(name)
        if number % len(LEFT_OUT):
            name = np.full(len(n), 1, np.uint64)
            for at in errors:
                name = mix(name * ODD + values[:, chunk * WIDTH + at])
            names.append(name)
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(there)
        there = here if alone else there
        step = max(1, 10 * CHUNK_PAIRS // max(1, len(there)))
        for k in range(0, len(here), step):
            part = here[k:k + step]
            apart = component[part][:, None] != component[there][None, :]
            if alone:
                apart &= part[:, None] < there[None, :]
            for name in names:
                apart &= name[part][:, None] != name[there][None, :]
            i, j = np.nonzero(apart)
            for s in range(0, len(i), CHUNK_PAIRS):
                x, y = part[i[s:s + CHUNK_PAIRS]], there[j[s:s + CHUNK_PAIRS]]
                keep = close(n[x], codes[x], n[y], codes[y])
                yield np.column_stack([x[keep], y[keep]])

    return compare


def _members(points: DataFrame) -> DataFrame:
    """(key, node): the buckets of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bucket_keys(_values(bytes_of(batch.column("code"))))
            offsets = pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["node", "keys"])

    return points.select("node", "code").mapInArrow(run, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def minhash_groups(docs: DataFrame, rule: Rule = Rule(words=5, num=85, den=100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links.

    A NULL text or one without words has no shingles and stays alone. Rows that repeat an id or a text are linked like any others; a row
    without id is linked too and gets the smallest id of its group, NULL if there is none. No rows give none. Other columns than the two
    named are not looked at. The tables that the result is read from stay in the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    with bounded_batches(spark):
        nodes = Nodes(scratch, described(docs, rule, id_col, text, _code))
        met = scratch.put(buckets(_members(nodes.points)))
        linker = Linker(scratch, nodes, rule, within_radius(rule), lambda holders: nodes.named(sets_of(docs, holders, rule, id_col, text)))
        component = linker.run(met, compare_signatures(rule))
        return groups_of(nodes, component)

"""Fill-in-middle rows: a text is cut at two unit ends and its parts are put in another order.

A unit is white space with the word behind it, or the white space at the end: `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`.
All of a unit's borders are ASCII, so units are found in the UTF-8 bytes. These are viewed as 64-bit words, and sums and shifts on
whole words set one bit for each byte that ends a unit (the last of a text, or no white space before white space). `bitwise_count`
gives the ends per word. Its running sum says how many ends lie before any byte (rank) and, searched, which word holds the k-th
end; halving the word finds the byte in it (select). Code points are counted the same way, by the bytes that begin one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def _each(byte: int) -> np.uint64:
    return np.uint64(byte) * ONES


def _zero_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0. No carry leaves a byte."""
    return ~(((words & LOW) + LOW) | words) & HIGH


def white_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is ASCII white space: 0x20, or 0x09 to 0x0D."""
    seven = words & LOW
    within = (seven + _each(0x80 - 0x09)) & ~(seven + _each(0x80 - 0x0E)) & ~words & HIGH
    return within | _zero_bytes(words ^ _each(0x20))


class Marks:
    """Marked bytes of a run of words, with rank and select. A mark is a byte's high bit."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def before(self, byte: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each of the given ones."""
        word, shift = byte >> 3, (byte & 7).astype(np.uint64) * np.uint64(8)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << shift) - np.uint64(1))
        return self.sums[word] + np.bitwise_count(inside)

    def place(self, number: np.ndarray) -> np.ndarray:
        """The byte of each numbered mark, from 0 on."""
        word = np.searchsorted(self.sums, number, side="right") - 1
        left, found = number - self.sums[word], np.zeros(len(number), np.int64)
        rest = self.words[word]
        for half in (4, 2, 1):
            mask = (np.uint64(1) << np.uint64(8 * half)) - np.uint64(1)
            lower = np.bitwise_count(rest & mask).astype(np.int64)
            beyond = left >= lower
            left, found = left - np.where(beyond, lower, 0), found + np.where(beyond, half, 0)
            rest = np.where(beyond, rest >> np.uint64(8 * half), rest & mask)
        return (word << 3) + found


def unit_marks(data: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """(bytes that end a unit, bytes that begin a code point) of texts lying one after another, the i-th before byte ends[i]."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    white = white_bytes(words)
    following = (white >> np.uint64(8)) | (np.append(white[1:], np.uint64(0)) << np.uint64(56))
    marks = ~white & following & HIGH
    last = ends[np.diff(ends, prepend=0) > 0] - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * np.uint64(8)))
    beginning = (~words | (words << np.uint64(1))) & HIGH
    return Marks(marks), Marks(beginning)


def _numbers(seed: int, doc_id) -> tuple[int, int, int, int]:
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(drawn[4 * i:4 * i + 4], "big") for i in range(4))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50,
                   suffix_first: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of `docs`.

    `share` of 100 texts are cut and `suffix_first` of 100 of these written as `spm`, else as `psm`. What is drawn follows from
    `seed` and the row's id alone, so repeated ids draw the same numbers and rows without id those of an empty one. An empty or
    NULL text has n = 0; it and texts that hold a sentinel are `plain`, with NULL for the lengths. Parts may be empty. No rows give
    none; other columns of `docs` are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            texts = pa.compute.fill_null(batch.column("_text"), "").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
            units, chars = unit_marks(data, ends)
            first, n = units.before(starts), units.before(ends) - units.before(starts)
            ids = batch.column("_id").to_pylist()
            drawn = np.array([_numbers(seed, i) for i in ids], np.int64).reshape(-1, 4)
            low, high = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1).T
            held = pa.compute.match_substring_regex(texts, SENTINELS).to_numpy(zero_copy_only=False)
            plain = (ends == starts) | held | (drawn[:, 2] % 100 >= share)
            spm = drawn[:, 3] % 100 < suffix_first

            def after(count):
                """The byte behind the first `count` units of each text."""
                place, some = starts.copy(), count > 0
                place[some] = units.place(first[some] + count[some] - 1) + 1
                return place

            a, b = after(low), after(high)
            prefix_chars, middle_chars = chars.before(a) - chars.before(starts), chars.before(b) - chars.before(a)
            raw, output = data.tobytes(), []
            for s, p, m, e, whole, late in zip(*(x.tolist() for x in (starts, a, b, ends, plain, spm))):
                if whole:
                    output.append(raw[s:e].decode())
                    continue
                prefix, middle, suffix = raw[s:p].decode(), raw[p:m].decode(), raw[m:e].decode()
                output.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if late
                              else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
            return {"doc_id": batch.column("_id"), "n": n, "form": np.where(plain, "plain", np.where(spm, "spm", "psm")),
                    "prefix_chars": pa.array(prefix_chars, mask=plain), "middle_chars": pa.array(middle_chars, mask=plain),
                    "output": output}

        return step

    named = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    return map_texts(named, "_text", f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string", work)


def restored(output: Column, form: Column) -> Column:
    """The text that a row was made of. The text of a cut row holds no sentinel, so the output holds just its three."""
    parts = F.split(output, SENTINELS)
    prefix = F.when(form == "psm", parts[1]).otherwise(parts[2])
    suffix = F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))

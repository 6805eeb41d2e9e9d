"""Quality rules on repetition, from the suffix array of a document's words.

Suffixes are sorted by prefix doubling over many documents at once: words get numbers of their own in each document, so suffixes
of different documents never share a prefix, and every sort is one numpy call. Neighbours' common prefixes follow from the ranks
kept for each power of two. The longest prefix that a suffix shares with either neighbour is the deepest interval of common
prefixes that holds it, hence the longest substring from there that occurs twice. Every maximal repeated substring is such a
prefix at each of its places, and each such prefix lies in a maximal repeat, so the union of their spans is the union of the
maximal repeats' spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cleanframe.functions.columns import ref
from cleanframe.llm.common import map_texts

SYMBOLS = "#*$%&|<>"
BLANK = re.compile(r"[\x20\x09-\x0D]")
WINDOW = 5
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, covered_words long, longest_repeat long")


@dataclass(frozen=True)
class Limits:
    """A repeat counts from `least` words. A document fails if repeats cover more than `covered` of its words, or if one is
    longer than `longest` words."""

    least: int = 8
    covered: float = 0.15
    longest: int = 60
    base_words: int = 10
    base_percent: int = 20


def longest_repeats(words: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from there that occurs at another place too."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while True:
        now = ranks[-1]
        after = np.full(n, -1, np.int64)
        after[:n - step] = now[step:]
        pair = now * (n + 1) + after + 1
        order = np.argsort(pair)
        fresh = np.empty(n, bool)
        fresh[0] = False
        np.not_equal(pair[order[1:]], pair[order[:-1]], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        ranks.append(rank)
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    order = np.argsort(ranks[-1])
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size = 1 << k
        inside = (a + size <= n) & (b + size <= n)
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        common[same] += size
        a[same] += size
        b[same] += size
    out = np.zeros(n, np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def _covered(length: np.ndarray, least: int, n: int, fixed: bool = False) -> np.ndarray:
    """Which places lie in the span [i, i + length) of some i with length of at least `least`; `fixed` spans have `least`."""
    at = np.flatnonzero(length >= least)
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + (least if fixed else length[at]), minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def measure(texts: list[str | None], limits: Limits) -> dict:
    """The columns of SCHEMA for some texts."""
    count = len(texts)
    words_of, chars, symbols, lines = [], np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    numbers: list[int] = []
    for i, text in enumerate(texts):
        index: dict[bytes, int] = {}
        base = len(numbers)
        if text:
            raw = text.encode("utf-8", "surrogatepass")
            numbers.extend([base + index.setdefault(w, len(index)) for w in raw.split()])
            chars[i] = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
            symbols[i] = sum(text.count(c) for c in SYMBOLS)
            with_words = [line for line in raw.split(b"\n") if line.strip()]
            lines[i] = len(with_words) - len(set(with_words))
        words_of.append(len(numbers) - base)
    sizes = np.array(words_of, np.int64)
    longest = longest_repeats(np.array(numbers, np.int64))
    # A prefix shared by two suffixes ends within their document: each document's numbers are its own.
    starts = np.cumsum(sizes) - sizes
    windows = _covered(longest, WINDOW, len(numbers), fixed=True)
    spans = _covered(longest, limits.least, len(numbers))

    def per_text(value: np.ndarray, how) -> np.ndarray:
        out = np.zeros(count, np.int64)
        if len(numbers):
            out[sizes > 0] = how.reduceat(value.astype(np.int64), starts[sizes > 0])
        return out

    repeat, covered, most = per_text(windows, np.add), per_text(spans, np.add), per_text(longest, np.maximum)
    failed = (sizes < limits.base_words) | (100 * repeat > limits.base_percent * sizes)
    kept = ~failed & (covered <= limits.covered * sizes) & (most <= limits.longest)
    return {"n_words": sizes, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat,
            "base_failed": failed, "kept": kept, "covered_words": covered, "longest_repeat": most}


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns of SCHEMA for every row: counts, whether the base rules fail, and the verdict `kept`.

    NULL and empty texts have no words and fail. Rows that repeat an id or a text, and NULL ids, are measured like any other;
    no rows give none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("_id"), **measure(batch.column("_text").to_pylist(), limits)}

    named = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    return map_texts(named, "_text", f"doc_id {kind}, {SCHEMA}", lambda: step)

"""Documents as sets of word shingles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from cleanframe.llm.common import mix

ODD = np.uint64(0x9E3779B97F4A7C15)
DIMENSIONS = 256
MOST = 0xFF


@dataclass(frozen=True)
class Rule:
    """What a set is and when two link: den * overlap >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def needed(self, total):
        """The least overlap of linked sets whose sizes add up to `total`."""
        return -(-self.num * total // (self.num + self.den))

    def smallest_partner(self, size: int) -> int:
        return -(-self.num * size // self.den)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, A to Z lowered, words parted by ASCII white space. With
    fewer words than a shingle, the whole sequence is one; without words there is none."""
    index: dict[bytes, int] = {}
    places: list[int] = []
    counts = []
    for text in texts:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        places.extend([index.setdefault(t, len(index)) for t in tokens])
        counts.append(len(tokens))
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in index], np.uint64)
    flat = hashes[np.array(places, np.int64)] if places else np.zeros(0, np.uint64)
    if len(flat) >= words:
        rolled = np.zeros(len(flat) - words + 1, np.uint64)
        for i in range(words):
            rolled = mix(rolled * ODD + flat[i:len(flat) - words + 1 + i])
    out, at = [], 0
    for n in counts:
        if n >= words:
            out.append(np.unique(rolled[at:at + n - words + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for h in flat[at:at + n]:
                one = mix(one * ODD + h)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def count_codes(sets: list[np.ndarray]) -> list[bytes]:
    """The group counts of each set, a byte each. A set with a count too large for it gets `MOST` everywhere, which no bound excludes."""
    out = []
    for found in sets:
        counts = np.bincount((found >> np.uint64(8)) % np.uint64(DIMENSIONS), minlength=DIMENSIONS)
        out.append((counts if counts.max() < MOST else np.full(DIMENSIONS, MOST)).astype(np.uint8).tobytes())
    return out


def overlap_bound(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """What two sets can have in common at most: the sum of the smaller counts, or anything if both have counts beyond a byte."""
    least = np.minimum(one, two).sum(axis=-1, dtype=np.int64)
    return np.where((one[..., 0] == MOST) & (two[..., 0] == MOST), np.int64(2**62), least)

"""Token ids of whole texts, with each distinct blank-separated part encoded once per Python worker."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np
import public_tokenizers
import tiktoken

from cleanframe.llm.common import gather

VOCABULARY = "byte_bpe_50k.tiktoken"
MANY_LANGUAGES = "byte_bpe_multi_50k.tiktoken"
CACHED = 150_000
#: A blank between white space: only there the pattern does not cut before each blank.
SPACE = re.compile(r"\s")
UNSPLIT = re.compile(r"\s \s|\s \Z")


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = place = len(self)
        self.new.append(key)
        return place


class Encoder:
    """Ids of a byte-level BPE. The `special` strings (with their ids) are cut out before, others are ordinary text.

    The vocabulary's split pattern always cuts before a single blank, so a text is the sequence of its blank-separated
    parts, and each distinct part is encoded once. Texts where a blank stands between white space are encoded whole.
    At most `CACHED` parts are held, besides those of one batch.
    """

    def __init__(self, path: str, special: dict[str, int] | None = None):
        self.special = special or {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = encoding.encode_ordinary
        self.array = lambda text: np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)
        self.line = self.plain("\n")
        self.clear()

    def clear(self):
        self.index = _Index()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self):
        """Encode the new parts. Those without white space go through one call, a line end between them: the pattern
        cuts before and after it, and no other id of such a text is its id."""
        new, self.index.new = self.index.new, []
        if not new:
            return
        together = [i for i, k in enumerate(new) if k.__class__ is str and k and not SPACE.search(k)]
        if len(self.line) != 1:
            together = []
        flat = self.array("\n".join([" " + new[i] for i in together])) if together else np.zeros(0, np.uint32)
        ends = np.append(np.flatnonzero(flat == self.line[0]), len(flat))
        starts, lengths = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        if together:
            starts[together] = np.append(0, ends[:-1] + 1)
            lengths[together] = ends - starts[together]
        alone = sorted(set(range(len(new))).difference(together))
        got = [np.array(self._whole(k[0]) if isinstance(k, tuple) else self.plain(" " + k), np.uint32) for k in map(new.__getitem__, alone)]
        if alone:
            lengths[alone] = sizes = np.array([len(ids) for ids in got], np.int64)
            starts[alone] = len(flat) + np.cumsum(sizes) - sizes
        self.starts = np.concatenate([self.starts, len(self.ids) + starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat, *got])

    def _whole(self, text: str) -> list[int]:
        """A special string, or text without any."""
        return [self.special[text]] if text in self.special else self.plain(text)

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by `end`; ids of each text with its end)."""
        if len(self.index) > CACHED:
            self.clear()
        places: list[int] = []
        parts = np.zeros(len(texts), np.int64)
        find = self.index.__getitem__
        for row, text in enumerate(texts):
            before = len(places)
            if not text:
                pass
            elif self.cut and self.cut.search(text):
                places.extend(find((part,)) for part in self.cut.split(text) if part)
            elif UNSPLIT.search(text):
                places.append(find((text,)))
            else:
                first, *rest = text.split(" ")
                if first:
                    places.append(find((first,)))
                places.extend(map(find, rest))
            places.append(-1)
            parts[row] = len(places) - before
        self._learn()
        order = np.array(places, np.int64)
        lengths = np.append(self.lengths, 1)[order]
        flat = np.append(self.ids, np.uint32(end))[gather(np.append(self.starts, len(self.ids))[order], lengths)]
        ends = np.cumsum(lengths)[np.cumsum(parts) - 1] if len(texts) else np.zeros(0, np.int64)
        return flat, np.diff(ends, prepend=0)


def added_tokens(path: str) -> dict[str, int]:
    """The special strings of the tokenizer file that lies beside a rank file, with their ids; none if there is no such file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


@functools.lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder for all tasks of a Python worker, so that the vocabulary is read once. Its parts stay known until `clear`."""
    return Encoder(path, added_tokens(path) if special else None)

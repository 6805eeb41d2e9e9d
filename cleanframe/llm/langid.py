"""Language of words and documents by a linear-chain conditional random field.

A text is a sequence of words (runs of letters, lowered), cut into chains of at most `CHAIN` words. A word's features are hashed
character sequences of one to four symbols between two boundary marks, so that prefixes and suffixes are among them, the word
itself, and its lexicon: the languages that list it among their most typical words. Each feature has a weight per label, and
each ordered pair of labels a learned transition. Forward and backward recursions give every word a distribution over the labels; a
document's distribution is the mean over its words, so mixed documents show their shares.

Training maximises the likelihood of labelled chains by gradient ascent with one step size per weight. The labels of a chain come
from documents of one language each; to learn transitions, runs of words from documents of different languages are joined into
code-switched chains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import LETTERS, gather, map_texts, mix

UNKNOWN = "und"
CHAIN = 64
GRAM = 4
BUCKETS = 1 << 16
LEXICON_WORDS = 1_000
SAMPLE_ROWS = 250
SAMPLE_CHARS = 20_000
SAMPLE_WORDS = 20_000
EPOCHS = 6
MOST_LABELS = 200


@dataclass
class Field:
    """`weights`: (buckets, labels); `lexicon`: word to the labels that list it; `listed`: (labels, labels)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, np.ndarray]
    listed: np.ndarray


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the features of all words, number of features of each word)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(["\0" + w + "\0" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    found, owners = [], []
    rolled = mix(points + np.uint64(1))
    whole = np.add.reduceat(mix(rolled * (room.astype(np.uint64) * np.uint64(2) + np.uint64(1))), np.cumsum(lengths) - lengths)
    for size in range(1, GRAM + 1):
        if size > 1:
            rolled = mix(rolled[:-1] * np.uint64(31) + points[size - 1:])
        at = np.flatnonzero(room[:len(rolled)] >= size)
        if size == 1:
            at = at[points[at] > 0]
        found.append((rolled[at] + np.uint64(size)) % np.uint64(BUCKETS))
        owners.append(owner[at])
    found.append(mix(whole + np.uint64(77)) % np.uint64(BUCKETS))
    owners.append(np.arange(len(words)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found).astype(np.int64)[order], np.bincount(np.concatenate(owners), minlength=len(words))


def emissions(field: Field, words: list[str]) -> np.ndarray:
    """The score of each label for each word."""
    buckets, counts = grams(words)
    if not len(buckets):
        return np.zeros((len(words), len(field.labels)))
    out = np.add.reduceat(field.weights[buckets], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
    for i, w in enumerate(words):
        if w in field.lexicon:
            out[i] += field.lexicon[w] @ field.listed
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over chains laid end to end. Returns (probability of each label of each word, expected number of each
    transition if `pairs`). Chains run side by side, longest first, so one step serves all of them."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    steps, k = int(size[0]) if len(size) else 0, scores.shape[1]
    live = np.searchsorted(-size, -np.arange(steps), side="left")
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - top)
    move = np.exp(transitions)
    forward, backward = np.zeros_like(emit), np.ones_like(emit)
    for t in range(steps):
        at = begin[:live[t]] + t
        a = np.exp(start)[None, :] * emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = begin[:live[t + 1]] + t
        b = (backward[at + 1] * emit[at + 1]) @ move.T
        backward[at] = b / b.sum(axis=1, keepdims=True)
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return p, None
    expected = np.zeros((k, k))
    last = np.zeros(len(scores), bool)
    last[begin + size - 1] = True
    at = np.flatnonzero(~last)
    joint = forward[at][:, :, None] * move[None] * (backward[at + 1] * emit[at + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    expected += joint.sum(axis=0)
    return p, expected


def _chains(rng, words: list[np.ndarray], label: list[int], total: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training chains: of one language, and as many of runs from several."""
    pieces = [(w[a:a + CHAIN], y) for w, y in zip(words, label) for a in range(0, len(w), CHAIN)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    chains, used = [], 0
    for w, y in pieces:
        if used >= total:
            break
        chains.append((w, np.full(len(w), y)))
        used += len(w)
    for _ in range(len(chains)):
        parts = [chains[i] for i in rng.integers(0, len(chains), rng.integers(2, 5))]
        cut = [(lambda a, n: (w[a:a + n], y[a:a + n]))(int(rng.integers(0, len(w))), int(rng.integers(4, 25))) for w, y in parts]
        chains.append((np.concatenate([w for w, _ in cut])[:CHAIN], np.concatenate([y for _, y in cut])[:CHAIN]))
    return chains


def train(texts: list[str], langs: list[str], sample_words: int = SAMPLE_WORDS, epochs: int = EPOCHS, seed: int = 5) -> Field:
    """Learn from whole texts with their language. Without a word to learn from there are no labels."""
    index: dict[str, int] = {}
    words = [np.array([index.setdefault(w, len(index)) for w in LETTERS.findall(t.lower())], np.int64) for t in texts]
    some = [i for i, w in enumerate(words) if len(w)]
    labels = sorted({langs[i] for i in some})
    k = len(labels)
    number = {name: i for i, name in enumerate(labels)}
    y = [number[langs[i]] for i in some]
    words = [words[i] for i in some]
    if not k:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {}, np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    names = list(index)
    seen = np.zeros((k, len(names)))
    for w, label in zip(words, y):
        np.add.at(seen[label], w, 1)
    rate = (seen + 0.1) / (seen.sum(axis=1, keepdims=True) + 1)
    typical = rate * np.log(rate / (rate.sum(axis=0) / k))
    lexicon: dict[str, np.ndarray] = {}
    for label in range(k):
        for i in np.argsort(-typical[label], kind="stable")[:LEXICON_WORDS]:
            if seen[label, i] > 1 and typical[label, i] > 0:
                lexicon.setdefault(names[i], np.zeros(k))[label] = 1
    buckets, counts = grams(names)
    starts = np.cumsum(counts) - counts
    scale = 1 / np.sqrt(counts)
    listed_by = np.array([lexicon.get(n, np.zeros(k)) for n in names])
    field = Field(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k), lexicon, np.zeros((k, k)))
    parameters = [field.weights, field.transitions, field.start, field.listed]
    squares = [np.full(p.shape, 1e-2) for p in parameters]
    per_label = max(1, sample_words // k)
    chains = []
    for label in range(k):
        own = [w for w, one in zip(words, y) if one == label]
        chains.append((label, own))
    chains = _chains(rng, [w[a:a + CHAIN] for label, own in chains for w, a in _budget(rng, own, per_label)],
                     [label for label, own in chains for _ in _budget(rng, own, per_label)], sample_words * 2)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 40)):
            w = np.concatenate([chains[i][0] for i in batch])
            target = np.concatenate([chains[i][1] for i in batch])
            lengths = np.array([len(chains[i][0]) for i in batch])
            at = gather(starts[w], counts[w])
            own = np.repeat(np.arange(len(w)), counts[w])
            score = np.add.reduceat(field.weights[buckets[at]], np.cumsum(counts[w]) - counts[w], axis=0) * scale[w][:, None]
            score += listed_by[w] @ field.listed
            p, expected = marginals(score, lengths, field.transitions, field.start, pairs=True)
            error = np.eye(k)[target] - p
            first = np.cumsum(lengths) - lengths
            inner = np.ones(len(w), bool)
            inner[first] = False
            pair = np.zeros((k, k))
            np.add.at(pair, (target[np.flatnonzero(inner) - 1], target[inner]), 1)
            weights = np.zeros_like(field.weights)
            for label in range(k):
                weights[:, label] = np.bincount(buckets[at], weights=(error[:, label] * scale[w])[own], minlength=BUCKETS)
            gradients = [weights, pair - expected, error[first].sum(axis=0), listed_by[w].T @ error]
            for value, square, gradient in zip(parameters, squares, gradients):
                gradient = gradient / len(batch) - 1e-5 * value
                square += gradient ** 2
                value += 0.3 * gradient / np.sqrt(square)
    field.weights = field.weights.astype(np.float32)
    return field


def _budget(rng, own: list[np.ndarray], most: int) -> list[tuple[np.ndarray, int]]:
    """(words, start) of chains from documents in turn, up to `most` words."""
    out, used = [], 0
    for a in range(0, max((len(w) for w in own), default=0), CHAIN):
        for w in own:
            if a < len(w):
                out.append((w, a))
                used += min(CHAIN, len(w) - a)
                if used >= most:
                    return out
    return out


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, most likely language, its probability) of each word of a text."""
    words = LETTERS.findall(text.lower())
    if not words or not field.labels:
        return []
    p, _ = _label([words], field)
    return [(w, field.labels[i], float(q[i])) for w, q, i in zip(words, p, p.argmax(axis=1))]


def _label(texts: list[list[str]], field: Field) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of all words, number of words of each text)."""
    index: dict[str, int] = {}
    places = np.array([index.setdefault(w, len(index)) for words in texts for w in words], np.int64)
    counts = np.array([len(w) for w in texts], np.int64)
    chains = -(-counts // CHAIN)
    number = gather(np.zeros(len(counts), np.int64), chains)
    lengths = np.minimum(CHAIN, np.repeat(counts, chains) - number * CHAIN)
    scores = emissions(field, list(index))[places]
    return marginals(scores, lengths, field.transitions, field.start)[0], counts


def predict(field: Field, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, share of words labelled with another language) of each text."""
    words = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    words = [w if any(c.isalpha() for c in "".join(w[:4])) or any(c.isalpha() for x in w for c in x) else [] for w in words]
    names, scores, mixed = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    some = [i for i, w in enumerate(words) if w]
    if not some or not field.labels:
        return names, scores, mixed
    p, counts = _label([words[i] for i in some], field)
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(p, starts, axis=0) / counts[:, None]
    best = mean.argmax(axis=1)
    other = np.add.reduceat((p.argmax(axis=1) != np.repeat(best, counts)).astype(float), starts) / counts
    for i, b, q, o in zip(some, best, mean, other):
        names[i], scores[i], mixed[i] = field.labels[b], min(1.0, float(q[b])), o
    return names, scores, mixed


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
        chars: int = SAMPLE_CHARS) -> Field:
    """Learn from at most `rows` documents of each language of at most `chars` characters, chosen by a hash of the id, among
    rows that fulfil `use`. NULL ids, texts and languages are not learned from; of more than MOST_LABELS languages the most
    frequent are learned."""
    known = docs.where(use & ref(id_col).isNotNull() & ref(lang).isNotNull()).select(
        ref(id_col).alias("_id"), ref(lang).alias("_lang"))
    counts = known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MOST_LABELS).collect()
    names: dict = {}
    for one in counts:
        rank = F.xxhash64("_id", F.lit(3))
        own = known.where(F.col("_lang") == one["_lang"]).orderBy(rank, "_id").limit(rows)
        names |= {r["_id"]: one["_lang"] for r in own.select("_id").collect()}
    if not names:
        return train([], [])
    sample = (docs.where(ref(id_col).isin(list(names)) & (F.length(ref(text)) <= chars) & ref(lang).isNotNull())
              .select(ref(id_col).alias("_id"), ref(text).alias("_text"), ref(lang).alias("_lang")).collect())
    sample = sorted({(r["_id"], r["_text"], r["_lang"]) for r in sample})[:2 * rows * len(counts)]
    return train([t for _, t, _ in sample], [name for _, _, name in sample])


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixed) for every row: the language with the highest mean probability, that mean, and the share
    of words labelled with another one.

    `und` with score 0 for NULL texts, texts without a letter, and if nothing was learned. Ties go to the first language by
    name. Rows that repeat an id, and NULL ids, are labelled like any other.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        names, score, mixed = predict(field, batch.column("_text").to_pylist())
        return {"doc_id": batch.column("_id"), "lang_pred": names, "score": score, "mixed": mixed}

    named = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    return map_texts(named, "_text", f"doc_id {kind}, lang_pred string, score double, mixed double", lambda: step)

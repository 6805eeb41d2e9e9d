"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

Kernel. A word is a sequence of letters between two boundary marks. Its features are all ordered quadruples of its symbols that
lie within `SPAN` places, each weighted by DECAY ** (places from first to last); two words are as alike as these features'
product, divided by the norm that a word of that length without repetition has. A dropped, inserted or masked character
leaves most of them in place. A sentence is worth as much as its worst word.

Training. Words of the sample serve as landmarks: those most typical of rows labelled 1, common ones, and those of other rows
that the machine of the first round takes for insults. With K the kernel among them, K^(-1/2) k(landmarks, word) is the word's
Nyström vector. A row is toxic because of some word of some sentence, so the machine learns from the worst words of the worst sentences of
each positive row, chosen anew in every round among words that rows labelled 1 have e times as often, against the worst words of sentences of negative rows, gathered over the rounds. A logistic
curve, fitted on rows held back from that, turns the worst value of a row into a score.

Scoring. The machine is linear in the quadruples, so landmarks, Nyström map and weights collapse into one weight for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import map_texts, release, text_slices

SPAN, DECAY, SYMBOLS = 7, 0.6, 32
LANDMARKS = 160
SAMPLE_ROWS = 600
SAMPLE_CHARS = 20_000
SENTENCE_WORDS = 24
NEGATIVE_SENTENCES = 4_000
ROUNDS = 4
WITNESSES = 4
WITNESS_ODDS = 1.0
THRESHOLD = 0.7
#: Whole rows are held beside the texts that are scored at once.
SCORED_CHARS = 500_000
SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|\n+")
NO_LETTER = re.compile(r"[\W\d_]+")
OFFSETS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


@dataclass
class Model:
    """`constant` holds for every row if the labels left nothing to learn."""

    weights: np.ndarray | None
    bias: float
    slope: float
    shift: float
    constant: float | None = None


class Sentences:
    """Distinct tokens of some texts, and the tokens of each sentence in pieces of at most SENTENCE_WORDS. Pieces only choose what to
    learn from; letters are joined over whole sentences."""

    def __init__(self, texts: list[str | None]):
        index: dict[str, int] = {}
        places: list[int] = []
        lengths: list[int] = []
        whole: list[int] = []
        counts = []
        for text in texts:
            before = len(lengths)
            for sentence in SENTENCE.split(text.lower()) if text else ():
                tokens = sentence.split()
                places.extend([index.setdefault(t, len(index)) for t in tokens])
                whole.append(len(tokens))
                for a in range(0, len(tokens), SENTENCE_WORDS):
                    lengths.append(min(SENTENCE_WORDS, len(tokens) - a))
            counts.append(len(lengths) - before)
        self.words = [NO_LETTER.sub("", t) for t in index]
        self.places = np.array(places, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.counts = np.array(counts, np.int64)
        self._join_spelled(np.array(whole, np.int64))

    def _join_spelled(self, whole: np.ndarray):
        """Letters that stand alone, three or more in a row within a sentence, also count as the word they spell. It belongs to the
        piece that holds the first of them. `whole` has the tokens of each sentence."""
        single = np.array([len(w) == 1 for w in self.words], bool)
        at = np.flatnonzero(single[self.places]) if len(self.places) else self.places
        self.spelled: list[tuple[int, int]] = []
        if len(at) < 3:
            return
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        sentence = np.repeat(np.arange(len(whole)), whole)
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(sentence[at]) > 0)) + 1
        for run in np.split(at, cut):
            if len(run) > 2:
                self.words.append("".join(self.words[i] for i in self.places[run]))
                self.spelled.append((int(owner[run[0]]), len(self.words) - 1))

    def worst(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the highest value of a word in each sentence, that word)."""
        if not len(self.places):
            return np.zeros(0), np.zeros(0, np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        own = value[self.places]
        high = np.maximum.reduceat(own, starts)
        at = np.flatnonzero(own == np.repeat(high, self.lengths))
        owner = np.repeat(np.arange(len(starts)), self.lengths)[at]
        word = self.places[at[np.unique(owner, return_index=True)[1]]]
        for sentence, spelled in self.spelled:
            if value[spelled] > high[sentence]:
                high[sentence], word[sentence] = value[spelled], spelled
        return high, word

    def highest(self, value: np.ndarray) -> np.ndarray:
        """The highest value of a word in each text, 0 without words."""
        out = np.zeros(len(self.counts))
        if len(self.places):
            words = np.add.reduceat(self.lengths, (np.cumsum(self.counts) - self.counts)[self.counts > 0])
            out[self.counts > 0] = np.maximum.reduceat(value[self.places], np.cumsum(words) - words)
            row = np.repeat(np.arange(len(self.counts)), self.counts)
            for sentence, spelled in self.spelled:
                out[row[sentence]] = max(out[row[sentence]], value[spelled])
        return out


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words, each between two marks; length of each with its marks). a to z, five more, a mark."""
    points = np.frombuffer("".join(["\0" + w + "\0" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (points >= 97) & (points <= 122)
    codes = np.where(letter, points - 96, np.where(points == 0, 0, 27 + points % 5)).astype(np.int32)
    return codes, np.array([len(w) + 2 for w in words], np.int64)


def _norms(lengths: np.ndarray) -> np.ndarray:
    ways = np.bincount([c for *_, c in OFFSETS], minlength=SPAN)
    squared = sum(ways[c] * np.maximum(lengths - c, 0) * DECAY ** (2 * (c + 1)) for c in range(3, SPAN))
    return np.sqrt(np.maximum(squared, DECAY ** 8))


def _occurrences(codes: np.ndarray, lengths: np.ndarray):
    """For each choice of offsets: (positions of first symbols, quadruple, weight)."""
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    for a, b, c in OFFSETS:
        at = np.flatnonzero(room > c)
        yield at, ((codes[at] * SYMBOLS + codes[at + a]) * SYMBOLS + codes[at + b]) * SYMBOLS + codes[at + c], DECAY ** (c + 1)


def word_values(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The machine's value of each word, without the bias."""
    if not words:
        return np.zeros(0)
    codes, lengths = _symbols(words)
    total = np.zeros(len(codes))
    for at, feature, weight in _occurrences(codes, lengths):
        total[at] += weight * weights[feature]
    return np.add.reduceat(total, np.cumsum(lengths) - lengths) / _norms(lengths)


def features(words: list[str], used: np.ndarray) -> np.ndarray:
    """A row per word: its weights of the sorted features `used`."""
    out = np.zeros((len(words), len(used)), np.float32)
    if words and len(used):
        codes, lengths = _symbols(words)
        owner = np.repeat(np.arange(len(words)), lengths)
        for at, feature, weight in _occurrences(codes, lengths):
            place = np.minimum(np.searchsorted(used, feature), len(used) - 1)
            same = used[place] == feature
            np.add.at(out, (owner[at[same]], place[same]), weight)
        out /= _norms(lengths)[:, None]
    return out


def used_by(words: list[str]) -> np.ndarray:
    """All features of the words."""
    return np.unique(np.concatenate([f for _, f, _ in _occurrences(*_symbols(words))]))


def kernel(words: list[str], marks: np.ndarray, used: np.ndarray) -> np.ndarray:
    """k(word, landmark), where `marks` has the landmarks' features `used`."""
    parts = [features(words[a:a + 512], used) @ marks.T for a in range(0, len(words), 512)]
    return np.concatenate(parts) if parts else np.zeros((0, len(marks)))


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, the classes weighted alike, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w):
        return 0.5 * w @ ridge @ w + cost / len(y) * 100 * (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(50):
        slack = 1 - y * (x @ w)
        active = slack > 0
        scale = cost / len(y) * 200 * share[active]
        gradient = ridge @ w - x[active].T @ (scale * y[active] * slack[active])
        step = np.linalg.solve(ridge + (x[active] * scale[:, None]).T @ x[active], gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, the classes weighted alike and a little pulled to the middle."""
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((~y).sum() + 2))
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    middle, scale = np.median(x), max(x.std(), 1e-6)
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (share * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, z.T @ (share * (p - target)) + 1e-4 * w)
        w = w - np.clip(step, -2, 2)
    slope = max(w[0], 1e-6) / scale
    return slope, w[1] - slope * middle


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Learn from whole texts and their labels. One class alone, or no word at all, gives that class's constant score."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Model(None, 0, 0, 0, float(bool(len(y) and y.all())))
    rng = np.random.default_rng(seed)
    parts = Sentences(texts)
    held = np.zeros(len(y), bool)
    for side in (True, False):
        rows = np.flatnonzero(y == side)
        held[rng.permutation(rows)[:len(rows) // 3]] = True
    owner = np.repeat(np.arange(len(y)), parts.counts)
    if not len(owner):
        return Model(None, 0, 0, 0, 0.0)

    word_row = np.unique(np.column_stack([parts.places, np.repeat(owner, parts.lengths)]), axis=0)
    word_row = word_row[~held[word_row[:, 1]]]
    seen = [np.bincount(word_row[y[word_row[:, 1]] == side, 0], minlength=len(parts.words)) for side in (True, False)]
    rows = [max(1, ((y == side) & ~held).sum()) for side in (True, False)]
    odds = np.log((seen[0] + 0.5) / rows[0]) - np.log((seen[1] + 0.5) / rows[1])
    letters = np.array([len(w) > 2 for w in parts.words])
    typical = np.where(letters, odds * np.sqrt(seen[0]), -1e9)
    common = np.where(letters, seen[1], -1)
    chosen = [*np.argsort(-typical, kind="stable")[:landmarks // 2], *np.argsort(-common, kind="stable")[:landmarks // 2]]
    names = sorted({parts.words[i] for i in chosen if parts.words[i]})
    if not names:
        return Model(None, 0, 0, 0, 0.0)
    value = np.where(letters, np.maximum(odds, 0) * np.sqrt(seen[0]), 0.0)
    begin = np.cumsum(parts.counts) - parts.counts
    positive = np.flatnonzero(y & ~held & (parts.counts > 0))
    negative = np.flatnonzero(~y[owner] & ~held[owner])
    against: set[int] = set()
    weights = bias = None
    for turn in range(ROUNDS):
        high, word = parts.worst(value)
        worst = []
        for r in positive:
            own = np.arange(begin[r], begin[r] + parts.counts[r])
            own = own[odds[word[own]] > WITNESS_ODDS]
            best = own[np.argsort(-high[own], kind="stable")[:WITNESSES]]
            worst += dict.fromkeys(word[best[high[best] >= high[best[:1]] / 2]].tolist())
        if not worst or not len(negative):
            return Model(None, 0, 0, 0, 0.0)
        order = negative[np.argsort(-high[negative], kind="stable")]
        against |= set(word[order[:NEGATIVE_SENTENCES]].tolist() if turn else word[rng.permutation(order)].tolist()[:NEGATIVE_SENTENCES])
        if turn == 1:
            hard = list(dict.fromkeys(parts.words[i] for i in word[order[:20 * landmarks]]))
            names = sorted({*names, *[w for w in hard if w][:landmarks // 2]})
        if turn < 2:
            used = used_by(names)
            marks = features(names, used)
            spread, vector = np.linalg.eigh((marks @ marks.T).astype(float))
            root = (vector / np.sqrt(np.maximum(spread, 1e-3))) @ vector.T
            vectors: dict[int, np.ndarray] = {}
        rows = [*worst, *sorted(against)]
        fresh = sorted({int(i) for i in rows}.difference(vectors))
        vectors |= dict(zip(fresh, kernel([parts.words[i] for i in fresh], marks, used) @ root))
        w, bias = _machine(np.array([vectors[int(i)] for i in rows]), np.where(np.arange(len(rows)) < len(worst), 1.0, -1.0))
        weights = np.zeros(SYMBOLS ** 4, np.float32)
        weights[used] = marks.T @ (root @ w)
        value = word_values(parts.words, weights)

    highest = parts.highest(value) + bias
    fit = held if y[held].any() and (~y[held]).any() else np.ones(len(y), bool)
    slope, shift = _curve(highest[fit], y[fit])
    return Model(weights, float(bias), slope, shift)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """A score for each text. A text without words has the value 0 before the bias."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    parts = Sentences(texts)
    highest = parts.highest(word_values(parts.words, model.weights))
    return 1 / (1 + np.exp(-np.clip(model.slope * (highest + model.bias) + model.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most `rows` labelled rows of each class, of at most `chars` characters each, chosen by a hash of the id.

    `use` is a condition on labels' rows. NULL ids, labels and texts are not learned from; an id with several labels counts
    as toxic if one of them says so.
    """
    known = (labels.where(use & ref(id_col).isNotNull() & ref(label).isNotNull())
             .groupBy(ref(id_col).alias("_id")).agg(F.max(ref(label)).alias("_label")))
    rank = F.xxhash64("_id", F.lit(11))
    ids = {}
    for side in (0, 1):
        some = known.where(F.col("_label") == side).orderBy(rank, "_id").limit(rows)
        ids |= {r["_id"]: side for r in some.select("_id").collect()}
    if not ids:
        return train([], [])
    sample = (docs.where(ref(id_col).isin(list(ids)) & (F.length(ref(text)) <= chars))
              .select(ref(id_col).alias("_id"), ref(text).alias("_text")).collect())
    sample = sorted({(r["_id"], r["_text"]) for r in sample})[:4 * rows]
    return train([t for _, t in sample], [ids[i] for i, _ in sample])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row. NULL and empty texts get the score of a text without words; rows that
    repeat an id, and NULL ids, are scored like any other."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        score = scores(model, batch.column("_text").to_pylist())
        return {"doc_id": batch.column("_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    named = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    return map_texts(named, "_text", f"doc_id {kind}, score double, predicted int", lambda: step)


def keep_harmless(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold. NULL and empty texts are scored as `classify` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in text_slices(batch, text, SCORED_CHARS):
                    yield part.filter(pa.array(scores(model, part.column(text).to_pylist()) < threshold))
        finally:
            release()

    return docs.mapInArrow(run, docs.schema)

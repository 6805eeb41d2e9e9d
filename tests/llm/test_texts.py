"""The operators on whole texts, against plain versions of the same definitions."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cleanframe.llm import chunks, langid, packing, repetition, separators, toxicity
from cleanframe.llm.common import folds
from cleanframe.llm.queries import QUERIES
from cleanframe.llm.tokens import MANY_LANGUAGES, VOCABULARY, Encoder, added_tokens, encoder
from cleanframe.plans.storage import new_folder
from tests.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_DOCS = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  \n\t ", None, "s", 3), (4, "one", "en", None, 3),
            (4, "one", "en", None, 3), (None, "no id here", "en", "s", None), (5, "word " * 30_000, "en", "s", 150_000),
            (6, "é ü 　 ß \U0001f600", "de", "s", 9)]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and very long texts, repeated rows, and extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD_DOCS, DOC_SCHEMA)
    for name in ("score", "n", "key", "node", "start", "length", "piece", "_id", "_text", "_spans", "_key", "row", "hash", "words", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# Token ids and packing

@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab \n\t.'s1é　\x85\x1c\r", "'ll", " the", "<|endoftext|>"]), max_size=25).map("".join), max_size=6))
def test_ids_are_those_of_the_tokenizer(texts):
    flat, sizes = ENCODER.encode(texts, 2)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert flat[a:b].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [2]


ENCODER = Encoder(public_tokenizers.path(VOCABULARY), added_tokens(public_tokenizers.path(VOCABULARY)))
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_special_strings_are_cut_out():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> ", "<|endoftext", "plain  text <|endoftext|>\n\n y"]
    flat, sizes = ENCODER.encode(texts, 2)
    got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert got[0] == [64, 220, 50256, 275, 2]


def optimum(sizes, capacity):
    """The least number of bins, by trying every place."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room + sizes[i] <= capacity:
                bins.remove(room)
                go(i + 1, bins + [room + sizes[i]])
                bins.append(room)
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    fixed, left = packing.reduce_instance(counts, 20)
    assert all(sum(p) <= 20 for p, _ in fixed)
    rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == (optimum(sizes, 20) if sizes else 0)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40)))
def test_plans_hold_every_piece(counts):
    plan = packing.plan_sequences(counts, 50)
    held = {}
    for pattern, n in plan:
        assert sum(pattern) <= 50
        for s in pattern:
            held[s] = held.get(s, 0) + n
    assert held == counts


def test_packing_round_trip(spark, odd, empty):
    path = public_tokenizers.path(VOCABULARY)
    pieces = packing.stored(packing.token_pieces(odd, path))
    packed = packing.pack(pieces, ["doc_id", "piece", "start"]).collect()
    texts = {i: TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in ODD_DOCS}
    found = {}
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 1024 and ids == texts[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        found.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in packed) == sum(len(texts[i]) for i, *_ in ODD_DOCS)
    assert packing.sequences(packing.pack(pieces, ["doc_id", "piece", "start"])).count() == len(found)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_lets_go_of_its_parts(spark):
    """Workers run tasks of other stages afterwards; what they know of texts must not stay with them."""
    path = public_tokenizers.path(VOCABULARY)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.lit("some words")).alias("text"))
    assert packing.pack_documents(docs.repartition(4), path).count() == 400

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"parts": pa.array([len(encoder(path, special=True).index)], pa.int64())})

    assert {r["parts"] for r in spark.range(40).repartition(4).mapInArrow(held, "parts long").collect()} == {0}


def test_encoder_holds_few_parts():
    """Two workers share an executor's memory with its heap: what they know of texts is bounded, and ids stay right when it is forgotten."""
    known = Encoder(public_tokenizers.path(VOCABULARY))
    texts = [" ".join(f"w{k}x{i}" for i in range(40_000)) for k in range(8)]
    first = known.encode(texts[:1], 2)[0].tolist()
    for text in texts:
        known.encode([text], 2)
        assert len(known.index) <= 200_000
    assert known.encode(texts[:1], 2)[0].tolist() == first == [*known.plain(texts[0]), 2]


@pytest.mark.parametrize("stage", [corpus_pipeline.harmless, corpus_pipeline.packing])
def test_pipeline_hands_workers_small_batches(spark, data, stage):
    """Rows of 1 MB: a batch may exceed its bound by the last of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        rows = stage(spark, spark.read.parquet(f"{data}/documents.parquet").limit(5), data)
        wide = spark.range(24).coalesce(1).select(F.repeat(F.lit("some word "), 100_000).alias("text"))
        sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches), "bytes long").collect()
        assert max(r["bytes"] for r in sizes) < 6_000_000 and sum(r["bytes"] for r in sizes) >= 24_000_000
        assert rows.count() >= 0
    finally:
        spark.conf.set(key, before)


def test_packing_query(spark, data):
    got = QUERIES["op9_best_fit_packing"](spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    total, filled = 0, {}
    for i, text in texts.items():
        ids = np.array(TOKENIZER.encode(text, add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
            assert r["length"] == 1024 or r["piece"] == 0
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += len(ids)
    assert len(filled) <= -(-total // 1024) + 2
    assert all(sum(n for _, n in v) <= 1024 for v in filled.values())


# Separator scan

@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan(spark, odd, block):
    folder = new_folder(spark, "flat")
    separators.write_tokens(odd, public_tokenizers.path(MANY_LANGUAGES), folder)
    encoder = Encoder(public_tokenizers.path(MANY_LANGUAGES))
    some = odd if block == 1000 else odd.where("length(text) < 100 OR text IS NULL")
    if block < 1000:
        folder = new_folder(spark, "flat")
        separators.write_tokens(some, public_tokenizers.path(MANY_LANGUAGES), folder)
    want = sorted(len(encoder.plain(r["text"] or "")) for r in some.collect())
    got = separators.token_counts(spark, folder, block=block, fan=2).collect()
    assert sorted(r["n_tokens"] for r in got) == want and all(r["closed"] for r in got)
    for name in {r["file"] for r in got}:
        mine = sorted((r for r in got if r["file"] == name), key=lambda r: r["document"])
        assert [r["document"] for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r["start"] == at
            at += r["n_tokens"] + 1


def test_separator_scan_of_raw_files(spark, tmp_path):
    ids = np.array([9, 9, 7, 7, 1, 2, 3, 7, 5, 5], "<u4")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = separators.token_counts(spark, str(tmp_path), end=7, width=4, block=2, fan=2)
    assert rows(got, "document", "start", "n_tokens", "closed") == [
        (0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, True), (3, 8, 2, False)]
    (tmp_path / "c.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number"):
        separators.token_counts(spark, str(tmp_path), end=7, width=4, block=2).collect()


def test_separator_query(spark, data):
    got = QUERIES["op2_separator_scan"](spark, data).collect()
    encoder = Encoder(public_tokenizers.path(MANY_LANGUAGES))
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(encoder.plain(r["text"])) for r in docs)


# Repetition

def brute_repeats(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_longest_repeats(words):
    assert repetition.longest_repeats(np.array(words, np.int64)).tolist() == brute_repeats(words)


def base(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat),
            len(words) < 10 or 100 * len(repeat) > 20 * len(words))


def test_repetition(spark, odd, empty):
    got = repetition.repetition(odd).collect()
    want = {(i, *base(t)) for i, t, *_ in ODD_DOCS}
    assert {tuple(r)[:7] for r in got} == want and len(got) == len(ODD_DOCS)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert repetition.repetition(empty).count() == 0
    words = [f"w{i}" for i in range(500)]
    twice = spark.createDataFrame([(1, " ".join(words + words[:70])), (2, " ".join(words + words[:9]))], "doc_id long, text string")
    assert rows(repetition.repetition(twice), "doc_id", "kept", "covered_words", "longest_repeat") == [(1, False, 140, 70), (2, True, 18, 9)]


def test_repetition_query(spark, data):
    got = {r["doc_id"]: r for r in QUERIES["op4_repetition"](spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        mine = got[r["doc_id"]]
        assert tuple(mine)[1:7] == base(r["text"])
        words = WORD.findall(r["text"])
        if len(words) < 300:
            longest = brute_repeats(words)
            covered = {i + k for i, n in enumerate(longest) if n >= 8 for k in range(n)}
            assert mine["covered_words"] == len(covered) and mine["longest_repeat"] == max(longest, default=0)
            assert mine["kept"] == (not mine["base_failed"] and len(covered) <= 0.15 * len(words) and max(longest, default=0) <= 60)


# Chunks

def passage(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_texts():
    rng = random.Random(3)
    texts = [None, "", "x", passage(rng, 400), "é" * 3000, "ab", "\x00" * 600, passage(rng, 50) * 3]
    found = chunks.chunk_texts(texts)
    for i, text in enumerate(texts):
        mine = [(a, b) for r, a, b in zip(found["row"], found["start"], found["end"]) if r == i]
        assert "".join(text[a:b] for a, b in mine) == (text or "")
        assert all(len(text[a:b].encode()) <= 260 for a, b in mine)
        assert sum(w for r, w in zip(found["row"], found["words"]) if r == i) == len(WORD.findall((text or "").replace("\x00", " ")))


def test_chunks_resist_insertions_and_neighbours():
    rng = random.Random(4)
    text = passage(rng, 300)
    alone, other = chunks.chunk_texts([text]), chunks.chunk_texts([passage(rng, 20), "zz" + text, passage(rng, 5)])
    same = set(alone["high"]) & set(other["high"][other["row"] == 1])
    assert len(same) >= len(alone["high"]) - 3
    assert set(chunks.chunk_texts([passage(rng, 9), text])["high"][-len(alone["high"]):]) == set(alone["high"])


def test_repeated_spans(spark, odd, empty):
    rng = random.Random(5)
    common = [passage(rng, 55) for _ in range(20)]
    docs, holders = [], {}
    for i in range(200):
        text = passage(rng, 120)
        if i % 4 == 0:
            k = i // 4 % 20
            text = text[:200] + " " + common[k] + " " + text[200:]
            holders.setdefault(k, []).append(i)
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seq", F.lit(1)).withColumn("first", F.lit("x"))
    spans = chunks.repeated_spans(df).collect()
    assert {r["doc_id"] for r in spans} == {i for own in holders.values() if len(own) > 1 for i in own}
    text = dict(docs)
    for k, own in holders.items():
        for r in spans:
            if r["doc_id"] in own and len(own) > 1:
                assert r["first_doc_id"] == min(own) and r["is_first"] == (r["doc_id"] == min(own))
                assert text[r["doc_id"]][r["start"] + 1:r["end"] - 1] in f" {common[k]} " and r["words"] >= 12
    left = {r["doc_id"]: r["text"] for r in chunks.without_repeats(df).collect()}
    for r in spans:
        assert (len(left[r["doc_id"]]) < len(text[r["doc_id"]])) != r["is_first"]
    assert chunks.without_repeats(df).columns == df.columns
    assert chunks.repeated_spans(odd).count() == 0 and chunks.without_repeats(odd).count() == len(ODD_DOCS)
    assert chunks.repeated_spans(empty).count() == 0


def test_chunk_query(spark, data):
    """Every pair of documents with a long common passage is found, and what is found is common."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    spans = QUERIES["op3_chunk_dedup"](spark, data).collect()
    for r in spans:
        if not r["is_first"]:
            assert any(docs[r["doc_id"]][r["start"]:r["end"]][20:60] in t for i, t in docs.items() if i < r["doc_id"])
    windows, long_ones = {}, set()
    for i, t in docs.items():
        words = WORD.findall(t)
        for k in range(0, len(words) - 49):
            windows.setdefault(" ".join(words[k:k + 50]), set()).add(i)
    for own in windows.values():
        if len(own) > 1:
            long_ones |= own
    assert len(long_ones - {r["doc_id"] for r in spans}) <= 0.02 * len(long_ones)


# Learned operators

def test_language(spark, odd, empty, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.fit(docs, folds(F.col("doc_id"), 4) != 2)
    held = langid.identify(docs.where(folds(F.col("doc_id"), 4) == 2), field).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    got = {r["doc_id"]: r for r in langid.identify(odd, field).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0 and 0 < got[5]["score"] <= 1
    assert langid.identify(odd, field).count() == len(ODD_DOCS) and langid.identify(empty, field).count() == 0
    assert langid.predict(field, ["123 ²½", "4 5"])[0] == ["und", "und"]
    nothing = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_of_words():
    rng = random.Random(1)
    speak = {"a": ["lalo", "lami", "lare", "lako"], "b": ["tisch", "fisch", "hosch", "rusch"]}
    texts = [" ".join(rng.choices(speak[x], k=60)) for x in "ab" * 40]
    field = langid.train(texts, list("ab" * 40))
    got = langid.label_words(field, "lami lano lare lalo tisch musch hosch fisch")
    assert [x for _, x, _ in got] == list("aaaabbbb")
    assert field.transitions[0, 0] > field.transitions[0, 1] and field.transitions[1, 1] > field.transitions[1, 0]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    scores, move, start, lengths = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([2, 4, 1, 2])
    got, pairs = langid.marginals(scores, lengths, move, start, pairs=True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in lengths:
        own, total, want = scores[at:at + n], 0.0, np.zeros((n, 3))
        joint = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            p = np.exp(start[path[0]] + sum(own[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
            for a, b in zip(path, path[1:]):
                joint[a, b] += p
        assert np.allclose(got[at:at + n], want / total)
        want_pairs += joint / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_kernel_tolerates_gaps():
    used = toxicity.used_by(["stupid"])
    mark = toxicity.features(["stupid"], used)
    k = dict(zip(["stupid", "stxupid", "stuupid", "stupi", "window"], toxicity.kernel(
        ["stupid", "stxupid", "stuupid", "stupi", "window"], mark, used)[:, 0]))
    assert k["stupid"] > k["stuupid"] > 0.4 and k["stxupid"] > 0.4 and k["window"] < 0.05


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    clean = ["".join(rng.choices("aeioulmnr", k=rng.randint(2, 8))) for _ in range(400)]
    texts = [". ".join(" ".join(rng.choices(clean, k=9)) for _ in range(8)) for _ in range(240)]
    toxic = [i % 3 == 0 for i in range(240)]
    texts = [t + f" {rng.choice(['blockhead', 'dunderkopf', 'stinkstiefel'])} {rng.choice(clean)}." if y else t for t, y in zip(texts, toxic)]
    model = toxicity.train(texts, [int(y) for y in toxic])
    got = toxicity.scores(model, [*texts, "lemon b l o c k h e a d", "blockkhead", "dunderxkopf", "", None])
    assert ((got[:240] >= 0.7) == toxic).mean() > 0.97
    assert (got[240:243] >= 0.5).all() and got[243] == got[244] < 0.5
    scored = toxicity.classify(odd, model)
    assert scored.count() == len(ODD_DOCS) and all(0 <= r["score"] <= 1 for r in scored.collect())
    assert toxicity.keep_harmless(odd, model).columns == odd.columns
    assert toxicity.keep_harmless(odd, model).count() == scored.where("predicted = 0").count()
    assert toxicity.classify(empty, model).count() == 0
    nothing = toxicity.fit(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.classify(odd, nothing).collect()} == {0.0}


def test_spelled_words_at_every_place_of_a_sentence():
    for at in range(61):
        words = ["lemon"] * 60
        words[at:at] = "s t u p i d".split()
        parts = toxicity.Sentences(["a b. " + " ".join(words) + ". c d", "e"])
        assert [parts.words[i] for _, i in parts.spelled] == ["stupid"]
        value = np.array([float(w == "stupid") for w in parts.words])
        assert parts.highest(value).tolist() == [1.0, 0.0]
        high, word = parts.worst(value)
        assert high.sum() == 1 and parts.words[word[high.argmax()]] == "stupid"
    assert not toxicity.Sentences(["lemon s t. u p", "i d lemon"]).spelled


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op8_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r["predicted"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert sum(bad) >= 0.75 * len(bad) and sum(good) <= 0.08 * len(good)

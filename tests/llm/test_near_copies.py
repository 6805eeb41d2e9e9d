"""Near copies by MinHash signatures, against plain versions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cleanframe.llm import linking, minhash
from cleanframe.llm.common import documents
from cleanframe.llm.queries import QUERIES
from cleanframe.llm.shingles import Rule, count_codes, overlap_bound
from cleanframe.plans.storage import Scratch
from tests.conftest import rows
from tests.llm.test_links import brute_groups
from tests.llm.test_texts import ODD_DOCS, empty, odd  # noqa: F401

RULE = Rule(words=5, num=85, den=100)


def expected(docs, rule=RULE):
    return sorted(brute_groups(docs, rule), key=str)


def found(groups):
    return sorted((tuple(r) for r in groups.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], [f"n{rng.random()}"], [words[at], f"n{rng.random()}"]])
    return words


def crowd(seed, bases=6, copies=40):
    """Exact and near copies around the threshold, chains of edits, and texts of few words."""
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 30, 120, 400]))]
        chain = base
        for _ in range(copies):
            texts.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 30)))))
            chain = edited(rng, chain, max(1, len(base) // 80)) if len(chain) > 5 else base
            texts.append(" ".join(chain))
    return list(enumerate(texts + ["a b", "A  b", "a", "", "x y z"]))


def test_query_against_all_pairs(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, data).collect()]
    got = QUERIES["op12_minhash_hamming"](spark, data)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == expected(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_crowds_against_all_pairs(spark, monkeypatch):
    docs = crowd(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = expected(docs)
    assert found(minhash.minhash_groups(df)) == want
    # Without rounds and with small blocks the comparison of blocks has to find what is left.
    monkeypatch.setattr(linking, "ROUNDS", 0)
    monkeypatch.setattr(linking, "BLOCK", 7)
    monkeypatch.setattr(linking, "SMALL", 5)
    assert found(minhash.minhash_groups(df)) == want


def test_groups_take_three_rounds_at_most(spark, monkeypatch):
    """However many groups meet in a bucket: one against its ends, one of forests, one where a pair of a forest is no link."""
    rounds, verify = [], linking.Linker.verify
    monkeypatch.setattr(linking.Linker, "verify", lambda self, pairs: rounds.append(1) or verify(self, pairs))
    docs = crowd(8, bases=4)
    assert found(minhash.minhash_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)
    assert 2 <= len(rounds) <= 3


def test_forests_of_pairs_that_are_no_links(spark, monkeypatch):
    """If any pair may be a link, most pairs of a forest are none, and the buckets are compared once more."""
    monkeypatch.setattr(minhash, "within_radius", lambda rule: lambda n, codes, m, others: np.ones(len(n), bool))
    docs = crowd(9, bases=3, copies=25)
    assert found(minhash.minhash_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)


def test_buckets_of_one_block_repeat_no_node(spark, monkeypatch):
    """A bucket that fits a block is compared as it is, once; only larger ones are cut and the smaller side repeated."""
    monkeypatch.setattr(linking, "SMALL", 5)

    def compare(n, codes, component, side, key):
        assert len(n) == 20 and not side.any()
        yield np.array([[0, 1], [1, 2]])

    placed = spark.createDataFrame([(1, k, max(0, k - 11)) for k in range(20)], "key long, node long, component long")
    points = spark.createDataFrame([(k, 3, b"x") for k in range(20)], "node long, n long, code binary")
    assert linking._residual(placed, points, None, compare, 100).count() <= 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 200), st.integers(0, 2**32))
def test_forest_connects_what_its_pairs_connect(rows, pairs, seed):
    rng = np.random.default_rng(seed)
    label, i, j = rng.integers(0, rows, rows), rng.integers(0, rows, pairs), rng.integers(0, rows, pairs)

    def groups(places):
        name = list(range(rows))
        for x, y in zip(label[i[places]].tolist(), label[j[places]].tolist()):
            name = [name[x] if n == name[y] else n for n in name]
        return {frozenset(k for k in range(rows) if name[k] == n) for n in name}

    kept = linking._forest(i, j, label)
    assert groups(kept) == groups(np.arange(pairs))
    assert len(kept) == rows - len(groups(kept))


def test_odd_rows(spark, odd, empty):  # noqa: F811
    got = minhash.minhash_groups(odd)
    assert found(got) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (5, 1, 5), (6, 1, 6)], key=str)
    assert minhash.minhash_groups(empty).collect() == []
    assert len(ODD_DOCS) == odd.count()


def test_repeated_ids_and_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(7, text), (7, "another text of its own altogether here"), (None, text + " end"), (9, text), (9, text)]
    got = minhash.minhash_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found(got) == sorted([(7, 56, 7), (7, 3, 7), (None, 57, 7), (9, 56, 7), (9, 56, 7)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, minhash.RADIUS))
def test_every_pair_within_the_radius_meets(seed, distance):
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 2**16, minhash.HASHES, dtype=np.uint16)
    two = one.copy()
    at = rng.choice(minhash.HASHES, distance, replace=False)
    two[at] ^= rng.integers(1, 2**16, distance, dtype=np.uint16)
    a, b = minhash.bucket_keys(np.stack([one, two]))
    assert set(a) & set(b)


def test_counts_beyond_a_byte_exclude_nothing():
    rng = np.random.default_rng(3)
    large = [np.unique(rng.integers(0, 2**64, 90_000, dtype=np.uint64)) for _ in range(2)]
    codes = np.frombuffer(b"".join(count_codes(large)), np.uint8).reshape(2, -1)
    assert (codes == 255).all() and (overlap_bound(codes, codes[::-1]) > 90_000).all()
    small = np.frombuffer(b"".join(count_codes([s[:200] for s in large])), np.uint8).reshape(2, -1)
    assert overlap_bound(small, small).tolist() == [200, 200] and (overlap_bound(small, small[::-1]) < 170).all()


def test_distance_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        got = []
        for _ in range(200):
            common = rng.integers(0, 2**63, round(400 * share), dtype=np.uint64)
            rest = rng.integers(0, 2**63, 400 - len(common), dtype=np.uint64)
            half = len(rest) // 2
            pair = [np.unique(np.concatenate([common, r])) for r in (rest[:half], rest[half:])]
            a, b = minhash.signatures(pair)
            got.append((a != b).sum())
        assert abs(np.mean(got) - minhash.HASHES * (1 - share)) < 1


def test_unequal_sets_with_one_half_of_a_hash_stay_apart(spark):
    scratch = Scratch(spark, "test")
    table = spark.createDataFrame([(1, 5, 10, 1, b"a"), (2, 5, 10, 2, b"b"), (3, 5, 11, 1, b"c"), (4, 0, None, None, None)],
                                  "doc_id long, n long, h1 long, h2 long, code binary")
    nodes = linking.Nodes(scratch, table)
    assert nodes.clash and nodes.points.select("node").distinct().count() == 3
    named = {r["doc_id"]: r["node"] for r in nodes.named(nodes.documents).collect()}
    assert named[4] is None and len({named[1], named[2], named[3]}) == 3
    assert set(rows(nodes.points, "node")) == {(named[1],), (named[2],), (named[3],)}


def test_scratch_tables_go(spark):
    scratch = Scratch(spark, "test")
    one, two = scratch.put(spark.range(3)), scratch.put(spark.range(4).select(F.col("id") + 1))
    scratch.drop(one)
    assert two.count() == 4
    scratch.clear(two)
    assert two.count() == 4 and len(scratch.paths) == 1

"""The Merkle manifest and fill-in-middle rows, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cleanframe.llm import merkle, middle
from cleanframe.llm.common import documents
from cleanframe.llm.queries import QUERIES
from tests.llm.test_texts import DOC_SCHEMA, ODD_DOCS, empty, odd  # noqa: F401

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest

def plain_levels(nodes, fanout):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        levels.append(nodes)
    return levels


def plain_way(levels, at, digest, fanout):
    """(digest at the root when one leaf is another, siblings met on the way)."""
    met = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        run = nodes[first:first + fanout]
        met += [d for i, d in enumerate(run) if i != at - first]
        run[at - first] = digest
        digest, at = h(*run), at // fanout
    return digest, met


def plain_manifest(rows, tampered, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) from rows (doc_id, text, lang, source, n_chars)."""
    def leaf(doc_id, text, lang, source, n_chars):
        parts = [doc_id, source, lang, n_chars, text]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts])

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is None, row[0] or 0, leaf(*row), row))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: r[:3])
    trees = {g: plain_levels([r[2] for r in groups[g]], fanout) for g in langs}
    top = plain_levels([trees[g][-1][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for at, (_, _, digest, row) in enumerate(groups[g]):
            seen = leaf(*row[:4], row[4] + 1) if tampered(row[0]) and row[4] is not None else digest
            sub, met = plain_way(trees[g], at, seen, fanout)
            folded, above = plain_way(top, k, sub, fanout)
            root = top[-1][0]
            out.append((row[0], digest, trees[g][-1][0], root, h(*met, *above), folded, folded == root))
    return sorted(out, key=str)


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def manifest_rows(df, fanout=2):
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    tree = merkle.manifest(df, seen={"n_chars": F.col("n_chars") + F.when(changed, 1).otherwise(0)}, fanout=fanout)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.fold(tree).select(*columns).collect()), key=str)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=20), st.integers(2, 5))
def test_states_are_those_of_sha256(leaves, fanout):
    digests = merkle._unpacked(b"".join(leaves))
    parents, states = merkle.raise_level(digests, fanout)
    want = plain_levels([x.hex() for x in leaves], fanout)[1] if len(leaves) > 1 else [h(leaves[0].hex())]
    assert [x.hex() for x in merkle._rows_of(parents)] == want
    # Hashing goes on from the state before any child.
    hexed = merkle.hex_blocks(digests)
    for at in range(len(leaves)):
        first, end = at - at % fanout, min(at - at % fanout + fanout, len(leaves))
        state = states[:, at:at + 1]
        for k in range(at, end):
            state = merkle.compress(state, hexed[:, k:k + 1])
        state = merkle.compress(state, merkle.ending(np.array([end - first])))
        assert merkle._rows_of(state)[0].hex() == want[at // fanout]


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, i // 2, None]), rng.choice(["ä text", "", None, f"t{i}"]), rng.choice(["en", "en", "en", "de", None, "é", "zz"]),
             rng.choice(["s", None]), rng.choice([i, None])) for i in range(n)]


@pytest.mark.parametrize("n,span,fanout", [(1, 1024, 2), (2, 1024, 2), (90, 4, 2), (90, 1024, 2), (70, 9, 3), (40, 5, 5)])
def test_manifest(spark, monkeypatch, n, span, fanout):
    monkeypatch.setattr(merkle, "SPAN", span)
    data = random_rows(n, n + span)
    df = spark.createDataFrame(data, DOC_SCHEMA).repartition(3).withColumn("tree", F.lit("x")).withColumn("leaf", F.lit(1))
    assert manifest_rows(df, fanout) == plain_manifest(data, tampered, fanout)


def test_manifest_of_odd_rows(spark, odd, empty):  # noqa: F811
    assert manifest_rows(odd) == plain_manifest(ODD_DOCS, tampered)
    assert manifest_rows(empty) == []
    assert merkle.manifest(empty).root is None


def test_manifest_query(spark, data):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents(spark, data).collect()]
    got = QUERIES["op11_merkle_manifest"](spark, data)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == plain_manifest(docs, tampered)


# Fill in the middle

def plain_middle(doc_id, text, seed=42, share=50):
    text = text or ""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return (doc_id, len(units), "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXT = st.text(st.sampled_from([*"ab <>PSM/\n\t\x0b\x0c\r\x08\x0e\x1f\x7f\x85", "é", "　", " ", "\U0001f600", "ß"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_marks_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - np.array([len(r) for r in raw])
    units, chars = middle.unit_marks(np.frombuffer(b"".join(raw), np.uint8), ends)
    for text, a, b in zip(texts, starts, ends):
        found = UNIT.findall(text)
        first, last = units.before(np.array([a, b]))
        assert last - first == len(found) and np.diff(chars.before(np.array([a, b])))[0] == len(text)
        got = units.place(first + np.arange(len(found))) + 1 - a
        assert got.tolist() == np.cumsum([len(u.encode()) for u in found]).tolist()


def test_middle(spark, odd, empty):  # noqa: F811
    rng = random.Random(2)
    alphabet = [*"abc   \n\t<>", "<P", "<S>", "é", "\U0001f600"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(1000 + i, " ".join("w" * rng.randrange(1, 9) for _ in range(200)) + rng.choice(["", " ", "\n\n"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("output", F.lit("x")).repartition(3)
    for share in (50, 100):
        made = middle.fill_in_middle(df, share=share)
        whole = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        want = {i: plain_middle(i, t, share=share) for i, t in rows}
        assert {r["doc_id"]: tuple(r)[:6] for r in whole} == want
        assert all(r["back"] == dict(rows)[r["doc_id"]] for r in whole)
    assert {r["form"] for r in whole} == {"plain", "psm", "spm"}
    got = sorted((tuple(r) for r in middle.fill_in_middle(odd).collect()), key=str)
    assert got == sorted((plain_middle(i, t) for i, t, *_ in ODD_DOCS), key=str)
    assert middle.fill_in_middle(empty).collect() == []


def test_middle_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, data).collect()}
    for r in QUERIES["op13_fill_in_middle"](spark, data).collect():
        i, n, form, prefix, mid, output = plain_middle(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, mid)
        assert r["output_sha256"] == h(output) and r["restored_sha256"] == h(docs[r["doc_id"]] or "")

"""Merkle manifest of a table, whose inner nodes keep SHA-256 states, so that one changed row is followed to the root cheaply.

A node's digest is the SHA-256 of its children's digests as hex text. 64 characters are just one block of SHA-256, so the hash's
state before each child is 32 bytes. A parent keeps these states (midstates). To replace a child, hashing goes on from the state
kept before it, with the new digest and the siblings to its right; those to its left are never read again. States are data here,
which `hashlib` does not offer, so the compression function is written for many rows at once.

Rows are numbered in their group's order and cut into blocks of `SPAN` leaves. A task builds a block's levels; the digests of the
blocks are the leaves of the next round, until each group has one. A tree over the groups is made in the same way. So no task or
driver holds a tree, however large a group is: what is known above a block is a path of one step a level, made from the top down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.plans.ordering import with_position
from cleanframe.plans.skew import spread_lookup
from cleanframe.plans.storage import stored

SPAN = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<state:binary,left:binary,right:binary>>"


def _fraction(prime: int, root: int) -> int:
    """The first 32 bits behind the point of a prime's square or cube root."""
    scaled, low, high = prime << (32 * root), 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle ** root <= scaled else (low, middle)
    return low & 0xFFFFFFFF


PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
START = np.array([_fraction(p, 2) for p in PRIMES[:8]], np.uint32)
ROUND = np.array([_fraction(p, 3) for p in PRIMES[:64]], np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The SHA-256 states (8, n) after one more block (16, n) each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + w[t - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3)))
                     + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks (16, n) of their hex text."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8)
    text = np.stack([HEX[raw >> 4], HEX[raw & 15]], axis=-1).reshape(len(raw), 64)
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def ending(blocks: np.ndarray) -> np.ndarray:
    """The last block (16, n) of messages of so many whole blocks: the end mark and the length in bits."""
    out = np.zeros((16, len(blocks)), np.uint32)
    bits = blocks.astype(np.int64) * 512
    out[0], out[14], out[15] = 0x80000000, bits >> 32, bits & 0xFFFFFFFF
    return out


def _packed(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").reshape(-1, 8).T.astype(np.uint32)


def _starting(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def raise_level(digests: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """(the parents' digests; for each child its parent's state before it)."""
    n = digests.shape[1]
    states, hexed = np.empty_like(digests), hex_blocks(digests)
    after = _starting(-(-n // fanout))
    for slot in range(min(fanout, n)):
        here = np.arange(slot, n, fanout)
        states[:, here] = after[:, :len(here)]
        after[:, :len(here)] = compress(states[:, here], hexed[:, here])
    children = np.minimum(fanout, n - np.arange(after.shape[1]) * fanout)
    return compress(after, ending(children)), states


class Block:
    """The levels of one block: nodes and, for each, its parent's state before it."""

    def __init__(self, nodes: bytes, states: bytes, leaves: int, levels: int, fanout: int):
        self.fanout, self.sizes = fanout, [leaves]
        for _ in range(levels):
            self.sizes.append(-(-self.sizes[-1] // fanout))
        cuts = np.cumsum(self.sizes)[:-1]
        self.nodes = np.split(_unpacked(nodes), cuts, axis=1)
        self.states = np.split(_unpacked(states), cuts[:-1], axis=1) if levels else []

    def steps(self, slot: int) -> list[dict]:
        """What is met on the way from a leaf to the block's root."""
        out = []
        for nodes, states in zip(self.nodes, self.states):
            first, end = slot - slot % self.fanout, min(slot - slot % self.fanout + self.fanout, nodes.shape[1])
            out.append({"state": _packed(states[:, slot:slot + 1]), "left": _packed(nodes[:, first:slot]),
                        "right": _packed(nodes[:, slot + 1:end])})
            slot //= self.fanout
        return out


class Climb:
    """Replaced leaves on their way up, and the hash of the siblings met, all rows at once."""

    def __init__(self, digests: np.ndarray):
        self.digest, self.proof = digests, _starting(digests.shape[1])
        self.met = np.zeros(digests.shape[1], np.int64)

    def _meet(self, rows: np.ndarray, siblings: np.ndarray) -> None:
        self.proof[:, rows] = compress(self.proof[:, rows], siblings)
        self.met[rows] += 1

    def through(self, block: Block, slot: np.ndarray) -> None:
        fanout = block.fanout
        for nodes, states in zip(block.nodes, block.states):
            hexed, n = hex_blocks(nodes), nodes.shape[1]
            after = compress(states[:, slot], hex_blocks(self.digest))
            first = slot - slot % fanout
            for place in range(fanout):
                at = first + place
                rows = np.flatnonzero((at < n) & (at != slot))
                if len(rows):
                    self._meet(rows, hexed[:, at[rows]])
                right = rows[at[rows] > slot[rows]]
                if len(right):
                    after[:, right] = compress(after[:, right], hexed[:, at[right]])
            self.digest = compress(after, ending(np.minimum(fanout, n - first)))
            slot = slot // fanout

    def along(self, steps: list[dict]) -> None:
        rows = np.arange(self.digest.shape[1])
        for step in steps:
            left, right = (hex_blocks(_unpacked(step[side])) for side in ("left", "right"))
            after = compress(np.repeat(_unpacked(step["state"]), len(rows), axis=1), hex_blocks(self.digest))
            for i in range(left.shape[1]):
                self._meet(rows, np.repeat(left[:, i:i + 1], len(rows), axis=1))
            for i in range(right.shape[1]):
                sibling = np.repeat(right[:, i:i + 1], len(rows), axis=1)
                self._meet(rows, sibling)
                after = compress(after, sibling)
            self.digest = compress(after, ending(np.full(len(rows), left.shape[1] + right.shape[1] + 1)))

    def siblings(self) -> np.ndarray:
        """The hash of all siblings met, level by level, from left to right."""
        return compress(self.proof, ending(self.met))


def _rows_of(digests: np.ndarray) -> list[bytes]:
    data = _packed(digests)
    return [data[i:i + 32] for i in range(0, len(data), 32)]


def _of_rows(column: pa.ChunkedArray) -> np.ndarray:
    return _unpacked(b"".join(column.to_pylist()))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each value as UTF-8 byte count, `:` and value, `-` if it is NULL."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass(frozen=True)
class Forest:
    """`rounds[r]` has one row per block of round r: (tree, block, leaves, levels, height, nodes, states, digest); `height` is what is
    missing up to the tree's root. `roots` are (tree, digest)."""

    rounds: list[DataFrame]
    roots: DataFrame
    fanout: int
    bits: int

    @property
    def span(self) -> int:
        return self.fanout ** self.bits


def grow(leaves: DataFrame, fanout: int = 2) -> Forest:
    """Trees over (tree, position, digest, height), positions being dense from 0 in each tree."""
    bits = 1
    while fanout ** (bits + 1) <= SPAN:
        bits += 1

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        digests, height = _of_rows(table.column("digest")), table.column("height")[0].as_py()
        nodes, kept = [digests], []
        for _ in range(min(bits, height)):
            digests, states = raise_level(digests, fanout)
            nodes.append(digests)
            kept.append(states)
        return pa.table({
            "tree": table.column("tree")[:1], "block": table.column("block")[:1], "leaves": pa.array([table.num_rows], pa.int32()),
            "levels": pa.array([len(kept)], pa.int32()), "height": pa.array([height - len(kept)], pa.int32()),
            "nodes": [b"".join(map(_packed, nodes))], "states": [b"".join(map(_packed, kept))], "digest": [_packed(digests)]})

    rounds, roots, level = [], None, leaves
    while True:
        cut = level.select("tree", (F.col("position") / fanout ** bits).cast("long").alias("block"), "position", "digest", "height")
        blocks = stored(cut.groupBy("tree", "block").applyInArrow(
            build, "tree string, block long, leaves int, levels int, height int, nodes binary, states binary, digest binary"))
        rounds.append(blocks)
        done = blocks.where("height = 0").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        level = blocks.where("height > 0").select("tree", F.col("block").alias("position"), "digest", "height")
        if level.isEmpty():
            return Forest(rounds, roots, fanout, bits)


def _below(children: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    """(tree, position, steps, subroot) of children (tree, block, position, slot) under their parents with path."""

    def descend(mine: pa.Table, above: pa.Table) -> pa.Table:
        row = above.to_pylist()[0]
        block = Block(row["nodes"], row["states"], row["leaves"], row["levels"], fanout)
        steps = [block.steps(slot) + row["steps"] for slot in mine.column("slot").to_pylist()]
        return pa.table({"tree": mine.column("tree"), "position": mine.column("position"),
                         "steps": pa.array(steps, pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))),
                         "subroot": pa.array([row["subroot"]] * mine.num_rows, pa.binary())})

    return (children.groupBy("tree", "block").cogroup(parents.groupBy("tree", "block"))
            .applyInArrow(descend, f"tree string, position long, steps {STEPS}, subroot binary"))


def _children(level: DataFrame, span: int) -> DataFrame:
    block = (F.col("position") / span).cast("long")
    return level.select("tree", block.alias("block"), "position", (F.col("position") % span).cast("int").alias("slot"))


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The blocks of the first round with `steps` from their root up, beyond the tree's root as `above` (tree, steps, subroot) says."""
    known = None
    for r in range(len(forest.rounds) - 1, -1, -1):
        blocks = forest.rounds[r]
        paths = blocks.where("height = 0").select("tree", "block").join(above, "tree")
        if known is not None:
            under = _children(blocks.where("height > 0").select("tree", F.col("block").alias("position")), forest.span)
            lower = _below(under, known, forest.fanout).withColumnRenamed("position", "block")
            paths = paths.unionByName(lower)
        known = blocks.join(stored(paths), ["tree", "block"])
    return known


def _height(count: Column, fanout: int) -> Column:
    powers, at = [], 1
    while at < 2**62:
        powers.append(F.lit(at).cast("long"))
        at *= fanout
    return F.size(F.filter(F.array(*powers), lambda p: p < count))


@dataclass(frozen=True)
class Manifest:
    """`leaves` (doc_id, tree, position, leaf, seen), the groups' trees, the tree over their roots, and its root (NULL without rows)."""

    leaves: DataFrame
    groups: Forest
    top: Forest
    subroots: DataFrame
    root: bytes | None


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id",
             seen: dict[str, Column] | None = None, fanout: int = 2) -> Manifest:
    """The trees of a table: one per value of `group` over its rows by `order`, and one over these by value, NULL first.

    `seen` says what a later reading finds in some columns; without it, the same. Rows that repeat an id are ordered by digest,
    those without id come last. A NULL group is a group. A table without rows has no root. Only the columns named are read.
    """
    later = [(seen or {}).get(c, ref(c)) for c in columns]
    tree = F.coalesce(F.concat(F.lit("="), ref(group).cast("string")), F.lit("-"))
    read = stored(docs.select(ref(order).alias("doc_id"), tree.alias("tree"), leaf([ref(c) for c in columns]).alias("leaf"),
                              leaf(later).alias("seen")))
    placed = stored(with_position(read, ["tree", "doc_id", "leaf"], "place"))
    sizes = placed.groupBy("tree").agg(F.min("place").alias("first"), _height(F.count("*"), fanout).alias("height"))
    leaves = stored(spread_lookup(placed, stored(sizes), ["tree"]).select(
        "doc_id", "tree", (F.col("place") - F.col("first")).alias("position"), "leaf", "seen", "height"))
    groups = grow(leaves.select("tree", "position", F.col("leaf").alias("digest"), "height"), fanout)
    subroots = stored(with_position(stored(groups.roots), ["tree"], "position"))
    height = _height(F.lit(subroots.count()), fanout)
    top = grow(subroots.select(F.lit("").alias("tree"), "position", "digest", height.alias("height")), fanout)
    root = top.roots.first()
    return Manifest(leaves, groups, top, subroots, bytes(root["digest"]) if root else None)


def fold(tree: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hex text, one row per leaf.

    `folded_root` comes from what the later reading saw, through the states kept before each node on its way and the right
    siblings. `proof_sha256` is the hash of all siblings' digests, level by level, from left to right.
    """
    nothing = tree.top.roots.select("tree", F.array().cast(STEPS).alias("steps"), F.lit(None).cast("binary").alias("subroot"))
    one = tree.subroots.select(F.lit("").alias("tree"), "position")
    above = _below(_children(one, tree.top.span), with_paths(tree.top, nothing), tree.top.fanout)
    above = tree.subroots.join(above.select("position", "steps"), "position").select("tree", "steps", F.col("digest").alias("subroot"))
    blocks = with_paths(tree.groups, stored(above))
    kind = tree.leaves.schema["doc_id"].dataType.simpleString()
    span, fanout = tree.groups.span, tree.groups.fanout
    cut = tree.leaves.select("doc_id", "tree", (F.col("position") / span).cast("long").alias("block"),
                             (F.col("position") % span).cast("int").alias("slot"), "leaf", "seen")

    def climb(mine: pa.Table, kept: pa.Table) -> pa.Table:
        row = kept.to_pylist()[0]
        block = Block(row["nodes"], row["states"], row["leaves"], row["levels"], fanout)
        way = Climb(_of_rows(mine.column("seen")))
        way.through(block, mine.column("slot").to_numpy().astype(np.int64))
        way.along(row["steps"])
        return pa.table({"doc_id": mine.column("doc_id"), "leaf": mine.column("leaf"),
                         "subroot": pa.array([row["subroot"]] * mine.num_rows, pa.binary()),
                         "proof": _rows_of(way.siblings()), "folded": _rows_of(way.digest)})

    folded = (cut.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
              .applyInArrow(climb, f"doc_id {kind}, leaf binary, subroot binary, proof binary, folded binary"))

    def text(column: Column) -> Column:
        return F.lower(F.hex(column))

    root = F.lit(tree.root).cast("binary")
    return folded.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(root).alias("root"),
                         text(F.col("proof")).alias("proof_sha256"), text(F.col("folded")).alias("folded_root"),
                         (F.col("folded") == root).alias("verified"))

"""Groups of sets that links join, from buckets that no link can miss.

Sets come as rows (doc_id, n, h1, h2, code): the size, a hash of 128 bits, and some bytes from which `Close` bounds how alike two sets
can be. Equal sets are one node. Given (key, node), every two nodes of a key are compared unless links join them already or the
bound excludes them. Pairs are never listed for a whole bucket:

1. each node is held against the smallest or largest node of its buckets, the one of these it meets most often;
2. where one group has at least a `SHARE`th of a bucket of more than `BLOCK` nodes, or the bucket would make more than `BLOCKS` blocks, each
   node outside its largest group is held against one node of that, chosen anew in every round, as long as a round spares a tenth of
   the nodes that are left in buckets, and `ROUNDS` times at most. This is linear in the bucket;
3. buckets that still hold several groups are compared by code, in one task up to `BLOCK` nodes, beyond that in blocks, two to a task. Of
   the pairs that may be links a task gives a forest: no more than it takes to connect the groups that all of them connect;
4. where pairs of a forest turn out to be no links, the groups that these pairs connect are compared with each other, each node once however
   many buckets it is in, and with its set, so that tasks give forests of verified links. Two groups with a pair that may be a link are
   always connected in that way, since every forest connects what the pairs it stands for connect.

Pairs of the rounds before are verified on the sets. Only the sets of such pairs are made, each time from the texts again: a table of all
sets would be larger than the texts. After each round only its new links are joined to the groups known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import map_texts
from cleanframe.llm.shingles import Rule, shingle_sets
from cleanframe.operators.dedup.components import connected_components
from cleanframe.plans.storage import Scratch

BLOCK = 4_000
BLOCKS = 8
SHARE = 4
SMALL = 256
BUNDLE_ROWS = 5_000
SETS = 500
CHUNK_PAIRS = 20_000
ROUNDS = 8
MAP_BITS = 1 << 26
TASK_LINKS = 50_000
BATCH_BYTES = "16m"

#: (sizes, codes, sizes, codes) of two equally long lists of sets -> which of these pairs may be links.
Close = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Holders (doc_id) -> (node, shingles) of these documents; others, and a node more than once, may be listed too.
Sets = Callable[[DataFrame], DataFrame]
#: (sizes, codes, components, sides, key) of two blocks of a bucket (sides 0 and 1), or one (side 0) -> pairs of rows of different components that
#: may be links, some at a time. It may leave out pairs that meet in a bucket of a smaller key as well.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], Iterator[np.ndarray]]


@contextmanager
def bounded_batches(spark: SparkSession):
    """Within it, what Python workers get at once is bounded in bytes, however long single rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _hashes(found: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def described(docs: DataFrame, rule: Rule, id_col: str, text: str, code: Callable[[list[np.ndarray]], list[bytes]],
              keys: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n, h1, h2, code), the last three NULL for a set without shingles; also its buckets `keys` if these come from the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column("_text").to_pylist(), rule.words)
            full = [s for s in sets if len(s)]
            names, codes = iter([_hashes(s) for s in full]), iter(code(full))
            rows = [(*next(names), next(codes)) if len(s) else (None, None, None) for s in sets]
            return {"doc_id": batch.column("_id"), "n": [len(s) for s in sets], "h1": [r[0] for r in rows], "h2": [r[1] for r in rows],
                    "code": [r[2] for r in rows], "keys": [keys(s) if keys and len(s) else None for s in sets]}

        return step

    named = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"))
    schema = f"doc_id {kind}, n long, h1 long, h2 long, code binary"
    return map_texts(named, "_text", f"{schema}, keys array<long>" if keys else schema, work)


def sets_of(docs: DataFrame, holders: DataFrame, rule: Rule, id_col: str, text: str) -> DataFrame:
    """(h1, h2, shingles) of the documents whose ids are in `holders` (doc_id). A bitmap of at most `MAP_BITS` bits, which every holder
    passes, keeps most other documents out; some may be listed that are no holders, and sets more than once."""
    bits = min(MAP_BITS, 1 << max(10, (32 * holders.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    cells = (holders.groupBy(F.shiftright(place, 5).alias("cell"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int"))).alias("set")).toPandas())
    bitmap = np.zeros(bits >> 5, np.uint32)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["set"].to_numpy(np.int64).astype(np.uint32)

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            at = batch.column("_place").to_numpy()
            held = (bitmap[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
            sets = [s for s in shingle_sets(batch.column("_text").filter(pa.array(held)).to_pylist(), rule.words) if len(s)]
            names = [_hashes(s) for s in sets]
            return {"h1": [a for a, _ in names], "h2": [b for _, b in names], "shingles": [s.tobytes() for s in sets]}

        return step

    named = docs.select(F.pmod(F.xxhash64(ref(id_col)), F.lit(bits)).alias("_place"), ref(text).alias("_text"))
    return map_texts(named, "_text", "h1 long, h2 long, shingles binary", work)


class Nodes:
    """The distinct sets of documents: `points` (node, n, code, smallest), and each document's node."""

    def __init__(self, scratch: Scratch, rows: DataFrame):
        self.scratch = scratch
        rows = scratch.put(rows)
        self.documents = scratch.put(rows.select("doc_id", "n", "h1", "h2"))
        described = [F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "h1", "h2")]
        several = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("smallest"), *described)
        several = scratch.put(several)
        #: First halves of the hash that unequal sets share: one in 10^10 sets or so. Normally there are none.
        self.shared = scratch.put(several.groupBy("h1").agg(F.count("*").alias("sets"), F.min("h2").alias("first")).where("sets > 1"))
        self.clash = not self.shared.isEmpty()
        self.points, self.kept = several.withColumnRenamed("h1", "node").drop("h2"), several
        if self.clash:
            self.points = self.kept = scratch.put(self.named(several))
            scratch.drop(several)
        scratch.drop(rows)

    def forget(self, column: str) -> None:
        """Delete a column of `points` that nothing reads any more."""
        slim = self.scratch.put(self.points.drop(column))
        self.scratch.drop(self.kept)
        self.points = self.kept = slim

    def named(self, table: DataFrame) -> DataFrame:
        """`node` instead of the hash."""
        if not self.clash:
            return table.withColumnRenamed("h1", "node").drop("h2")
        other = F.col("first").isNotNull() & (F.col("h2") != F.col("first"))
        return (table.join(F.broadcast(self.shared.select("h1", "first")), "h1", "left")
                .withColumn("node", F.when(other, F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("h1", "h2", "first"))


def groups_of(nodes: Nodes, component: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents; those without shingles stay alone. Clears the scratch tables but those that
    this is read from."""
    scratch = nodes.scratch
    placed = nodes.points.join(component, "node", "left").select("node", "smallest", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    known = scratch.put(placed.join(smallest, "component").select("node", "component_id"))
    rows = scratch.put(nodes.named(nodes.documents)) if nodes.clash else nodes.documents
    scratch.clear(known, rows)
    return (rows.withColumnRenamed("h1", "node").join(known, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


class Linker:
    """Verified links between nodes, and the groups they form so far."""

    def __init__(self, scratch: Scratch, nodes: Nodes, rule: Rule, close: Close, sets: Sets):
        self.scratch, self.points, self.rule, self.close, self.sets = scratch, nodes.points, rule, close, sets
        self.component = scratch.put(nodes.points.select("node", F.col("node").alias("component")).limit(0))

    def _with(self, pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
        """The pairs with a column of both ends, as x and y, from a table that has the rows of these ends alone."""
        return (pairs.join(held.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
                .join(held.select(F.col("node").alias("b"), F.col(column).alias("y")), "b"))

    def _sets(self, ends: DataFrame) -> DataFrame:
        """A scratch table (node, shingles) of the nodes in `ends`."""
        holders = self.scratch.put(self.points.join(ends, "node", "left_semi").select("node", F.col("smallest").alias("doc_id")))
        found = self.sets(holders.select("doc_id")).join(holders.select("node"), "node", "left_semi")
        # A set may be listed more than once, that of a text with many copies very often.
        found = self.scratch.put(found.dropDuplicates(["node"]))
        self.scratch.drop(holders)
        return found

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose codes allow a link."""
        close = self.close

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column("x"), batch.column("y")
                keep = close(x.field("n").to_numpy(), bytes_of(x.field("code")), y.field("n").to_numpy(), bytes_of(y.field("code")))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        described = self.points.join(_ends(pairs), "node", "left_semi").select("node", F.struct("n", "code").alias("point"))
        return self._with(pairs, described, "point").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def verify(self, pairs: DataFrame) -> bool:
        """Join the groups that the links among these pairs connect. Was there any?"""
        if pairs.isEmpty():
            return False
        rule = self.rule

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    keep.append(_linked(rule, *(np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        sets = self._sets(_ends(pairs))
        both = self._with(pairs, sets, "shingles")
        links = self.scratch.put(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
        self.scratch.drop(sets)
        return self._join(links)

    def _join(self, links: DataFrame) -> bool:
        """Join the groups that these links connect, and delete the table. Was there any?"""
        count = links.count()
        if not count:
            self.scratch.drop(links)
            return False
        old = self.component
        between = (links.join(old.withColumnRenamed("node", "a"), "a", "left").withColumn("x", F.coalesce("component", "a")).drop("component")
                   .join(old.withColumnRenamed("node", "b"), "b", "left").withColumn("y", F.coalesce("component", "b")))
        forest = between.select("x", "y").coalesce(max(1, count // TASK_LINKS)).mapInArrow(_contracted, "x long, y long")
        joined = self.scratch.put(connected_components(forest, "x", "y"))
        moved = old.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
        ends = _ends(links).join(old.select("node"), "node", "left_anti")
        self.component = self.scratch.put(moved.unionByName(ends.join(joined, "node").select("node", "component")))
        self.scratch.drop(links, joined, old)
        return True

    def divided(self, members: DataFrame) -> DataFrame:
        """(key, node, component) in the buckets that hold several groups; others need no further look."""
        placed = (members.select("key", "node").join(self.component, "node", "left")
                  .select("key", "node", F.coalesce("component", "node").alias("component")))
        several = (placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                   .where("low != high").select("key"))
        return placed.join(several, "key", "left_semi")

    def _fewer(self, members: DataFrame) -> DataFrame:
        left = self.scratch.put(self.divided(members))
        self.scratch.drop(members)
        return left

    def _fresh(self, pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
        """The pairs that were not tried before."""
        for table in tried:
            pairs = pairs.join(table, ["a", "b"], "left_anti")
        return self.scratch.put(pairs)

    def _try(self, pairs: DataFrame, tried: list[DataFrame]) -> bool:
        """Was one of the pairs that were not tried before a link?"""
        pairs = self._fresh(pairs, tried)
        possible = self.scratch.put(self.possible(pairs))
        self.scratch.drop(pairs)
        tried.append(possible)
        return self.verify(possible)

    def _doubtful(self, found: DataFrame, members: DataFrame) -> DataFrame:
        """(key, node, component) of the members whose groups are connected by pairs (a, b) that links do not join, not even by way of others.
        The key is the same for all that such pairs connect."""
        root = self.component
        both = (found.join(root.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
                .join(root.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
                .select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x != y").distinct())
        between = self.scratch.put(both)
        if between.isEmpty():
            self.scratch.drop(between)
            return members.limit(0)
        around = connected_components(between, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("key"))
        placed = (members.select("node").distinct().join(root, "node", "left")
                  .select("node", F.coalesce("component", "node").alias("component")))
        doubtful = self.scratch.put(placed.join(around, "component").select("key", "node", "component"))
        self.scratch.drop(between)
        return doubtful

    def run(self, buckets: DataFrame, compare: Compare, block: int | None = None, rounds: int | None = None) -> DataFrame:
        """(node, component) of all linked nodes, from buckets (key, node, low, high, nodes)."""
        block, rounds = BLOCK if block is None else block, ROUNDS if rounds is None else rounds
        larger = buckets.where("nodes > 2")
        ends = larger.select("node", F.explode(F.array("low", "high")).alias("end")).where("node != end")
        star = _most_often(ends).unionByName(buckets.where("nodes = 2 AND node = low").select("node", F.col("high").alias("end")))
        tried: list[DataFrame] = []
        self._try(_pairs(star), tried)
        members = self.scratch.put(self.divided(larger))
        widest = buckets.agg(F.max("nodes")).first()[0] or 0
        left = members.count() if widest > block else 0
        for turn in range(rounds if widest > block else 0):
            if not self._try(_pairs(_most_often(_pivots(_wide(members, block), turn, block))), tried):
                break
            before, members = left, self._fewer(members)
            left = members.count()
            if 10 * left > 9 * before:
                break
        found = self.scratch.put(_residual(members, self.points, self.close, compare, block).select("a", "b").distinct())
        tried.append(self._fresh(found, tried))
        self.verify(tried[-1])
        doubtful = self._doubtful(found, members)
        if not doubtful.isEmpty():
            self._join(self._verified(doubtful, min(SETS, block)))
            self.scratch.drop(doubtful)
        self.scratch.drop(members, found, *tried)
        return self.component

    def _verified(self, placed: DataFrame, block: int) -> DataFrame:
        """A scratch table (a, b): links that connect, within each key, all that links between its nodes connect."""
        sets = self._sets(placed.select("node"))
        described = self.points.join(sets, "node")
        found = _residual(placed, described, self.close, _all_pairs(self.close), block, self.rule)
        found = self.scratch.put(found.select("a", "b").distinct())
        self.scratch.drop(sets)
        return found


def _linked(rule: Rule, one: np.ndarray, two: np.ndarray) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return rule.den * common >= rule.num * (len(one) + len(two) - common)


def _all_pairs(close: Close) -> Compare:
    """Compares all pairs of two blocks, or of one."""

    def compare(n: np.ndarray, codes: np.ndarray, component: np.ndarray, side: np.ndarray, key: int) -> Iterator[np.ndarray]:
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for row in here.tolist():
            others = there if len(there) else here[here > row]
            others = others[component[others] != component[row]]
            for s in range(0, len(others), CHUNK_PAIRS):
                y = others[s:s + CHUNK_PAIRS]
                x = np.full(len(y), row)
                keep = close(n[x], codes[x], n[y], codes[y])
                yield np.column_stack([x[keep], y[keep]])

    return compare


def bytes_of(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _pairs(ends: DataFrame) -> DataFrame:
    return ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def _most_often(ends: DataFrame) -> DataFrame:
    """(node, end): for each node the end that it is listed with most often."""
    times = ends.groupBy("node", "end").agg(F.count("*").alias("times"))
    return times.groupBy("node").agg(F.max(F.struct("times", "end")).alias("best")).select("node", F.col("best.end").alias("end"))


def _wide(placed: DataFrame, block: int) -> DataFrame:
    """The rows of buckets of more than `block` nodes."""
    return placed.join(placed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select("key"), "key", "left_semi")


def _pivots(placed: DataFrame, turn: int, block: int) -> DataFrame:
    """(node, end): in each bucket where this may link many, every node outside the largest component with one node of the largest."""
    per = placed.groupBy("key", "component").agg(
        F.count("*").alias("rows"), F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node")).alias("pivot"))
    main = (per.groupBy("key").agg(F.max(F.struct("rows", "component", "pivot")).alias("main"), F.sum("rows").alias("all"))
            .where((F.col("main.rows") * SHARE >= F.col("all")) | (F.col("all") > BLOCKS * block))
            .select("key", F.col("main.component").alias("main"), F.col("main.pivot.node").alias("end")))
    return placed.join(main, "key").where("component != main").select("node", "end")


def buckets(members: DataFrame) -> DataFrame:
    """(key, node, low, high, nodes) of the keys of several nodes; of keys with the same nodes one. Their smallest and largest node,
    their number and the nodes' hashes together tell whether they are the same."""
    # Both the counts and the join read this shuffle.
    members = members.where("key IS NOT NULL").repartition("key")
    held = (members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("nodes"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark")).where("nodes > 1"))
    one = held.groupBy("low", "high", "nodes", "mark").agg(F.min("key").alias("key"))
    return members.join(one.select("key", "low", "high", "nodes"), "key")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of a task's links (x, y) one to the smallest node that they connect for each node."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        top = node
        while root[top] != top:
            top = root[top]
        while root[node] != top:
            root[node], node = top, root[node]
        return top

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": list(root), "y": [find(node) for node in root]}, pa.schema([("x", pa.int64()), ("y", pa.int64())]))

    for batch in batches:
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            root.setdefault(x, x)
            root.setdefault(y, y)
            one, two = sorted((find(x), find(y)))
            root[two] = one
        if len(root) > 4 * TASK_LINKS:
            yield stars()
            root.clear()
    if root:
        yield stars()


def _forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) it takes to connect all labels that they connect."""
    one, two = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    _, first = np.unique(one * (label.max(initial=0) + 1) + two, return_index=True)
    root = np.arange(label.max(initial=0) + 1).tolist()
    keep = []
    for k, x, y in zip(first.tolist(), one[first].tolist(), two[first].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y] = x
            keep.append(k)
    return np.array(keep, np.int64)


def _merged(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The labels after one[k] and two[k] became the same label, for every k."""
    root = np.arange(label.max(initial=0) + 1).tolist()
    for x, y in zip(one.tolist(), two.tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    root = np.array(root, np.int64)
    while (root[root] != root).any():
        root = root[root]
    return root[label]


def _within(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of the same run, some runs at a time."""
    pairs = np.cumsum(sizes * sizes)
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(pairs // CHUNK_PAIRS)) + 1):
        wide = np.repeat(sizes[part], sizes[part])
        row = np.repeat(starts[part], sizes[part]) + np.arange(len(wide)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
        first = np.repeat(np.repeat(starts[part], sizes[part]), wide)
        i = np.repeat(row, wide)
        j = first + np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide)
        yield i[i < j], j[i < j]


def _residual(placed: DataFrame, points: DataFrame, close: Close, compare: Compare, block_rows: int, rule: Rule | None = None) -> DataFrame:
    """(key, a, b) that may be links across the components of a bucket, of those that a task finds no more than connect the components
    that they connect. With `rule`, points have their `shingles` too, and links by them count instead.

    Buckets of at most `SMALL` nodes are bundled, so that a call sees many, and their pairs compared by code. Others of at most
    `block_rows` are compared with themselves. In larger ones the rows of the largest component form one side, all others the other;
    both are cut into blocks by a hash. Only the smaller side is repeated, once per block of the larger.
    """
    small = min(SMALL, block_rows)
    bundles = max(1, placed.count() // (SETS if rule else BUNDLE_ROWS))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    sizes = (per.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("main"), F.sum("rows").alias("all"))
             .select("key", F.col("main.component").alias("main"), F.ceil(F.col("main.rows") / block_rows).cast("int").alias("mains"),
                     F.ceil((F.col("all") - F.col("main.rows")) / block_rows).cast("int").alias("others"), (F.col("all") <= small).alias("small"),
                     (F.col("all") <= block_rows).alias("whole")))
    own = placed.join(sizes, "key").withColumn("is_main", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")

    def cells(one, two, side):
        return F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), side.alias("side"))

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    across = F.when(F.col("is_main"), F.transform(upto(F.col("others")), lambda k: cells(F.col("block"), k, F.lit(0)))).otherwise(
        F.transform(upto(F.col("mains")), lambda k: cells(k, F.col("block"), F.lit(1))))
    among = F.when(F.col("is_main"), F.array().cast("array<struct<one:int,two:int,side:int>>")).otherwise(
        F.transform(upto(F.col("others")), lambda k: cells(
            -1 - F.least(F.col("block"), k), F.greatest(F.col("block"), k), F.when(F.col("block") <= k, 0).otherwise(1))))
    group = F.when(F.col("small"), F.pmod(F.xxhash64("key"), F.lit(bundles))).otherwise(F.col("key"))
    own = own.withColumn("block", block).withColumn("group", group)
    names = ["key", "small", "group", "node", "component"]
    # Only buckets of several blocks have rows that are repeated.
    whole = own.where("whole").select(*names, F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side"))
    cut = own.where("NOT whole").select(*names, F.explode(F.concat(across, among)).alias("cell")).select(*names, "cell.*")
    spread = whole.unionByName(cut).join(points, "node")

    def run(table: pa.Table) -> pa.Table:
        bundled = table.column("small")[0].as_py()
        if bundled:
            table = table.sort_by("key")
        node, n, key = table.column("node").to_numpy(), table.column("n").to_numpy(), table.column("key").to_numpy()
        codes, component = bytes_of(table.column("code").combine_chunks()), table.column("component").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in table.column("shingles")] if rule else []
        _, label = np.unique(component, return_inverse=True)
        if bundled:
            starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
            sizes = np.diff(np.append(starts, len(key)))
            _, label = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(key) + label, return_inverse=True)
            found = _bundle(starts, sizes, lambda i, j: label[i] != label[j], lambda i, j: close(n[i], codes[i], n[j], codes[j]))
        else:
            found = compare(n, codes, component, table.column("side").to_numpy(), int(key[0]))
        kept = [np.zeros((0, 2), np.int64)]
        for pairs in found:
            # What pairs before these connect needs no more of them, so neither pairs nor time pile up in a large group.
            pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
            if rule:
                pairs = pairs[np.array([_linked(rule, sets[i], sets[j]) for i, j in pairs.tolist()], bool)]
            if len(pairs):
                pairs = pairs[_forest(pairs[:, 0], pairs[:, 1], label)]
                label = _merged(label, label[pairs[:, 0]], label[pairs[:, 1]])
                kept.append(pairs)
        i, j = np.concatenate(kept).T
        return pa.table({"key": key[i], "a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    columns = [*names, "one", "two", "side", "n", "code", *(["shingles"] if rule else [])]
    return spread.select(*columns).groupBy("small", "group", "one", "two").applyInArrow(run, "key long, a long, b long")


def _bundle(starts: np.ndarray, sizes: np.ndarray, apart: Callable, close: Callable) -> Iterator[np.ndarray]:
    """The pairs of rows of the same run that may be links, some at a time."""
    for i, j in _within(starts, sizes):
        keep = apart(i, j)
        i, j = i[keep], j[keep]
        for s in range(0, len(i), CHUNK_PAIRS):
            x, y = i[s:s + CHUNK_PAIRS], j[s:s + CHUNK_PAIRS]
            keep = close(x, y)
            yield np.column_stack([x[keep], y[keep]])

"""Benchmark passages in documents, by SimHash over windows as long as the item, in DataFrame functions alone.

1. Words are runs without ASCII white space, letters lowered. Texts are compared by their distinct five-word shingles, each weighted
   by its number of characters: the weight of common shingles must be at least THRESHOLD of the weight of all.
2. Shingles that a document shares with an item are joined by their hash. Documents are cut into stretches as long as the item; a
   window that begins in one ends in the next at the latest, so the hits in both hold all that it has in common with the item, and
   stretches whose hits weigh less than THRESHOLD of the item hold no similar window.
3. In each other stretch the window that most hits align with the item gets a 64-bit SimHash of its words. Fingerprints are cut into
   RADIUS + 1 blocks, so two within RADIUS bits agree on a whole block: windows and items meet on (item, block, its bits), and
   their distance decides.
4. Each shingle counts for the windows in which it stands first, a range of starts. Running sums over these ranges give the exact
   similarity of every window of the stretch. They verify what the fingerprints found, choose the best
   window, and find what no fingerprint within RADIUS led to, so nothing is lost. `found_by` tells the two ways apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import unused
from cleanframe.plans.storage import Scratch

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20
#: Rows of a few numbers each; more are joined without broadcast.
BROADCAST_ROWS = 500_000
BLANKS = r"[\x20\x09-\x0D]+"
STRETCH = ["doc_id", "digest", "item", "n_words", "item_weight", "stretch", "first", "last"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS, -1), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """The hash of the shingle at each position; empty with fewer words."""
    last = F.size(words) - SHINGLE
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def weighted_shingles(words: Column) -> Column:
    """(hash, weight) of the shingle at each position; the weight is its number of characters."""
    sums = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: F.char_length(F.concat(
        *[F.get(words, i + k) for k in range(SHINGLE)])).cast("long"))
    return F.when(F.size(words) >= SHINGLE, F.arrays_zip(shingle_hashes(words).alias("hash"), sums.alias("weight")))


def simhash(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def sign(b):
        bit = F.call_function("shiftrightunsigned", F.lit(1).cast("long"), F.lit(0))
        votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(
            F.call_function("shiftrightunsigned", h, b).bitwiseAND(bit) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda all_bits, b: all_bits.bitwiseOR(sign(b)))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block, its bits): radius + 1 blocks, as even as 64 bits allow."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(fingerprint, 64 - b), 64 - b + a).alias("bits"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def distinct_weight(shingles: Column) -> Column:
    """The weight of the distinct shingles among some with repeats. Sorted, as array_distinct compares all structs with each other."""
    ordered = F.sort_array(F.transform(shingles, lambda x: F.struct(x["hash"].alias("hash"), x["weight"].alias("weight"))))

    def step(state, x):
        fresh = state["last"].isNull() | (state["last"] != x["hash"])
        return F.struct(x["hash"].alias("last"), (state["sum"] + F.when(fresh, x["weight"]).otherwise(0)).alias("sum"))

    first = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(ordered, first, step, lambda state: state["sum"])


def items_of(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item, n_words, item_weight, item_print, item_words, item_ids): each text of enough words once, numbered."""
    named = benchmark.select(ref(id_col).alias("item_id"), words_of(ref(text)).alias("words")).where(F.size("words") >= SHINGLE)
    # A struct, as NULL ids count too.
    texts = named.groupBy("words").agg(F.collect_set(F.struct("item_id")).alias("item_ids"))
    return texts.select(F.monotonically_increasing_id().alias("item"), F.size("words").alias("n_words"),
                        distinct_weight(weighted_shingles(F.col("words"))).alias("item_weight"), simhash(F.col("words")).alias("item_print"),
                        F.col("words").alias("item_words"), "item_ids")


def small(df: DataFrame) -> DataFrame:
    """A written table of few narrow rows is broadcast."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def places_of(items: DataFrame) -> DataFrame:
    """(item, n_words, item_weight, hash, weight, place): the distinct shingles of the items, each at its first place."""
    at = items.select("item", "n_words", "item_weight", F.posexplode(weighted_shingles(F.col("item_words"))).alias("place", "one"))
    return (at.groupBy("item", "n_words", "item_weight", "one.hash").agg(F.min(F.struct("place", "one.weight")).alias("first"))
            .select("item", "n_words", "item_weight", "hash", "first.weight", "first.place"))


def stretches_of(docs: DataFrame, places: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """The columns STRETCH and `hits` (at, hash, weight, place) of the stretches that can hold a similar window; windows begin at
    `first` to `last`. `digest` tells apart the rows of an id."""
    # posexplode_outer: for posexplode a filter on the array's size is inferred, which would hash every text twice.
    positions = (docs.select(ref(id_col).alias("doc_id"), F.xxhash64(ref(text)).alias("digest"), words_of(ref(text)).alias("words"))
                 .select("doc_id", "digest", F.size("words").alias("doc_words"), shingle_hashes(F.col("words")).alias("hashes"))
                 .select("doc_id", "digest", "doc_words", F.posexplode_outer("hashes").alias("at", "hash")))
    own = F.floor(F.col("at") / F.col("n_words")).cast("int")
    met = (positions.join(small(places), "hash").withColumn("stretch", F.explode(F.array(own, own - 1)))
           .where(F.col("stretch") >= 0))
    hits = met.groupBy("doc_id", "digest", "doc_words", "item", "n_words", "item_weight", "stretch").agg(
        F.collect_set(F.struct("at", "hash", "weight", "place")).alias("hits"))
    first = F.col("stretch") * F.col("n_words")
    last = F.least(first + F.col("n_words") - 1, F.greatest(F.col("doc_words") - F.col("n_words"), F.lit(0)))
    return (hits.where(distinct_weight(F.col("hits")) >= F.lit(threshold) * F.col("item_weight"))
            .withColumn("first", first).withColumn("last", last).where("first <= last").select(*STRETCH, "hits"))


def looked_up(cut: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest, item, stretch, start): the aligned windows whose fingerprints the index finds within the radius."""
    theirs = items.select("item", "item_print", F.inline(blocks(F.col("item_print"), radius)))
    window = F.slice("words", F.col("start") - F.col("first") + 1, F.col("n_words"))
    printed = cut.select("doc_id", "digest", "item", "stretch", "start", simhash(window).alias("print"))
    mine = printed.select("*", F.inline(blocks(F.col("print"), radius)))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius
    return mine.join(theirs, ["item", "block", "bits"]).where(near).select("doc_id", "digest", "item", "stretch", "start").distinct()


def aligned(near: DataFrame) -> DataFrame:
    """STRETCH and `start`: the window that most hits align with the item; the first of several."""
    fit = F.col("hit.at") - F.col("hit.place")
    each = near.select(*STRETCH, F.explode("hits").alias("hit")).select(*STRETCH, F.greatest(F.least(fit, "last"), "first").alias("start"))
    votes = each.groupBy(*STRETCH, "start").agg(F.count("*").alias("votes"))
    return votes.groupBy(*STRETCH).agg((-F.max(F.struct("votes", (-F.col("start")).alias("s")))["s"]).alias("start"))


def _ranges(shingles: DataFrame, name: str) -> DataFrame:
    """STRETCH, `start`, `own`, `common`: by how much the weight of windows changes where they begin at `start`. A shingle (at, hash,
    weight) counts, under `name`, for the windows that hold it and not its predecessor of the same hash."""
    before = F.lag("at").over(Window.partitionBy(*STRETCH, "hash").orderBy("at"))
    since = F.greatest(F.col("at") - F.col("n_words") + SHINGLE, "first", F.col("before") + 1)
    spans = (shingles.withColumn("before", before).withColumn("since", since).withColumn("till", F.least("at", "last"))
             .where("since <= till"))
    edges = F.array(F.struct(F.col("since").alias("start"), "weight"),
                    F.struct((F.col("till") + 1).alias("start"), (-F.col("weight")).alias("weight")))
    return spans.select(*STRETCH, F.inline(edges)).select(
        *STRETCH, "start", *[(F.col("weight") if c == name else F.lit(0).cast("long")).alias(c) for c in ("own", "common")])


def rated(near: DataFrame, cut: DataFrame) -> DataFrame:
    """STRETCH, `start`, `end`, `similarity`: the windows that begin at `start` to `end` are all as similar to the item."""
    held = (cut.select(*STRETCH, F.posexplode(weighted_shingles(F.col("words"))).alias("at", "one"))
            .select(*STRETCH, (F.col("first") + F.col("at")).alias("at"), "one.hash", "one.weight"))
    shared = near.select(*STRETCH, F.inline("hits")).select(*STRETCH, "at", "hash", "weight")
    edges = _ranges(held, "own").unionByName(_ranges(shared, "common"))
    steps = edges.groupBy(*STRETCH, "start").agg(F.sum("own").alias("own"), F.sum("common").alias("common"))
    order = Window.partitionBy(*STRETCH).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (steps.withColumn("own", F.sum("own").over(upto)).withColumn("common", F.sum("common").over(upto))
            .withColumn("end", F.coalesce(F.lead("start").over(order) - 1, "last")).where("start <= last"))
    return sums.select(*STRETCH, "start", "end", (F.col("common") / (F.col("own") + F.col("item_weight") - F.col("common"))).alias("similarity"))


def best_windows(docs: DataFrame, items: DataFrame, id_col: str, text: str, threshold: float, radius: int, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, item, start, n_words, distance, similarity, found_by): for each text of an id and each item found in it the
    most similar window, of several the first."""
    near = scratch.put(stretches_of(docs, scratch.put(places_of(items)), id_col, text, threshold))
    marks = [F.xxhash64("doc_id").alias("_id"), F.col("digest").alias("_text")]
    holders = scratch.put(near.select(*marks).distinct())
    named = docs.select(ref(id_col).alias("doc_id"), F.xxhash64(ref(text)).alias("digest"), ref(text).alias("text"))
    same = (F.xxhash64("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_text"))
    texts = scratch.put(named.join(small(holders), same, "left_semi").distinct()
                        .select(F.col("doc_id").alias("text_id"), F.col("digest").alias("text_digest"), words_of(F.col("text")).alias("words")))
    own = F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("digest") == F.col("text_digest"))
    span = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("n_words"))
    cut = scratch.put(aligned(near).join(texts, own).select(*STRETCH, "start", span.alias("words")))
    scratch.drop(texts, holders)
    by_print = looked_up(cut, items, radius)
    windows = scratch.put(rated(near, cut.drop("start")).where(F.col("similarity") >= threshold))
    scratch.drop(near)
    place = ["doc_id", "digest", "item", "stretch"]
    met = [windows[c].eqNullSafe(by_print[c]) for c in place]
    verified = (windows.join(by_print, [*met, (by_print["start"] >= windows["start"]) & (by_print["start"] <= windows["end"])], "left_semi")
                .select("doc_id", "digest", "item").distinct().withColumn("indexed", F.lit(True)))
    top = windows.groupBy("doc_id", "digest", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"), "stretch", "n_words")).alias("best"))
    top = top.select("doc_id", "digest", "item", "best.stretch", "best.n_words", "best.similarity", (-F.col("best.s")).alias("start"))
    top = scratch.put(_null_safe(top, verified, ["doc_id", "digest", "item"]))
    words = cut.select(*place, "first", "words")
    window = F.slice("words", F.col("start") - F.col("first") + 1, F.col("n_words"))
    printed = _null_safe(top, words, place).withColumn("print", simhash(window)).join(items.select("item", "item_print"), "item")
    return printed.select(
        "doc_id", "digest", "item", "start", "n_words", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("distance"),
        "similarity", F.when(F.col("indexed"), "fingerprint").otherwise("weight").alias("found_by"))


def _null_safe(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """A left join in which NULL ids are equal."""
    other = two.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in two.columns if c not in on])
    return one.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left").drop(*[f"_{c}" for c in on])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity, found_by): the most similar window for each document and item found
    in it, of equal ones the first; start counts words before it. Clean documents give no row.

    Every window of as many words as the item counts, or the whole of a shorter document. NULL or empty texts give none. Items with
    fewer words than a shingle are too short to tell from chance and match nothing. Rows that repeat an id are searched like others, and
    the best window of the id counts. Equal items are all listed. `found_by` is `fingerprint` where a SimHash within `radius` led to a
    similar window of the text, `weight` where only the running sums did.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    items = scratch.put(items_of(benchmark, item_id, item_text))
    found = scratch.put(best_windows(docs, items, id_col, text, threshold, radius, scratch))
    scratch.clear(items, found)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"), "n_words", "found_by"))
    named = found.join(items.select("item", F.explode("item_ids.item_id").alias("item_id")), "item")
    return (named.groupBy("doc_id", "item_id").agg(best.alias("best"))
            .select("doc_id", "item_id", (-F.col("best.s")).alias("start"), "best.n_words", (-F.col("best.d")).alias("distance"),
                    "best.similarity", "best.found_by"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no item is found. Rows are judged by id and text, so of two texts under one id only
    the one with an item goes; rows without id are judged like others."""
    scratch = Scratch(docs.sparkSession, "benchmark")
    items = scratch.put(items_of(benchmark, "item_id", "text"))
    found = best_windows(docs, items, id_col, text, THRESHOLD, RADIUS, scratch)
    key, digest = unused(docs, "_key"), unused(docs, "_digest")
    gone = scratch.put(found.select(F.col("doc_id").alias(key), F.col("digest").alias(digest)).distinct())
    scratch.clear(gone)
    same = ref(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(ref(text)) == F.col(digest))
    return docs.join(small(gone), same, "left_anti").select(*[ref(c) for c in docs.columns])

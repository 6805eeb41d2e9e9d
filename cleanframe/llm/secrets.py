"""Secrets in documents, and whether they belong to one owner, in DataFrame functions alone.

Three kinds of matches are always reported. Other long strings that look random are candidates: they are reported only if the
whole corpus knows them from few owners and few repositories. Strings that many owners share are examples copied from
manuals; a string of one owner looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.llm.common import unused
from cleanframe.plans.storage import stored

# The patterns and least lengths of the kinds that are always reported.
KEYWORDS = ["password", "passwd", "secret", "token"]
LEAST = {"assign": 12, "access": 18, "hex": 16}
CASED = "|".join(["".join(f"[{c.upper()}{c}]" for c in w) for w in KEYWORDS] + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
PATTERNS = {
    "assign": rf"""({CASED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
}
#: Beside them: a long run with a digit, a small and a capital letter.
RANDOM = "random"
PATTERNS_ALL = {**PATTERNS, RANDOM: "[A-Za-z0-9+/_=-]{20,}"}
KINDS = list(PATTERNS_ALL)
DISTINCT_CHARACTERS = 12
MOST_OWNERS = 1
MOST_REPOSITORIES = 3
MASK = "<secret>"


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, kind: str) -> Column:
    """(start, kind number, end, value) of the leftmost non-overlapping matches, in code points. The text before each match and
    the matches, laid end to end, give the places."""
    pattern = PATTERNS_ALL[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    lengths = F.zip_with(before, found, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size"),
                                                              m.alias("value")))

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + one["gap"]
        end = start + one["size"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), one["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
    placed = F.aggregate(lengths, first, step, lambda state: state["found"])
    return F.filter(F.when(F.size(found) > 0, placed).otherwise(F.array().cast(SPANS)), lambda x: _kept(x["value"], kind))


def _kept(value: Column, kind: str) -> Column:
    if kind == RANDOM:
        mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARACTERS)
    return F.char_length(secret(value, kind)) >= LEAST[kind]


def secret(value: Column, kind: str) -> Column:
    """What is secret in a match: the assigned value, else all of it."""
    return F.regexp_extract(value, PATTERNS["assign"], 2) if kind == "assign" else value


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _overlaps(one: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < one["end"]) & (one["start"] < o["end"]))


def candidates(docs: DataFrame, owner: str, repository: str, id_col: str, text: str) -> DataFrame:
    """One row per document: its spans of the fixed kinds, and the random-looking ones that touch none of these."""
    content = F.coalesce(ref(text), F.lit(""))
    raw = docs.select(ref(id_col).alias("doc_id"), ref(owner).cast("string").alias("owner"),
                      ref(repository).cast("string").alias("repository"),
                      F.concat(*[matches(content, k) for k in PATTERNS]).alias("base"), matches(content, RANDOM).alias("more"))
    apart = F.filter("more", lambda m: ~_overlaps(m, F.col("base")))
    return raw.withColumn("more", apart).withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(hash, repositories, owners, owned) of the candidates (hash, owner, repository), of which any number may be equal.

    Equal rows are combined before they are shuffled, so a string in a third of all documents costs a row per owner and
    repository and task. A NULL owner or repository counts as one of its own.
    """
    named = found.select("hash", F.struct("owner").alias("owner"), F.struct("owner", "repository").alias("repository"))
    per = named.distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    total = per.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    return total.withColumn("owned", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind, end, value), n_owned (spans whose string has one
    owner) and n_shared (spans whose string is widely copied).

    `base` holds the fixed kinds; `spans` adds random-looking strings of one owner. NULL and empty texts have no spans; rows
    that repeat an id or a text, and NULL ids, are searched like any other; equal strings of several kinds count as one string.
    """
    rows = stored(candidates(docs, owner, repository, id_col, text))
    one = (rows.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
           .withColumn("hash", F.sha2(F.when(F.col("span.kind") == 0, secret(F.col("span.value"), "assign"))
                                      .otherwise(F.col("span.value")), 256)))
    judged = one.select("row", "hash", "span").join(ownership(one), "hash")
    added = F.filter(F.collect_list(F.when(F.col("owned") & (F.col("span.kind") == KINDS.index(RANDOM)), F.col("span"))),
                     lambda x: x.isNotNull())
    per_row = judged.groupBy("row").agg(added.alias("added"), F.count_if("owned").alias("n_owned"),
                                        F.count_if(~F.col("owned")).alias("n_shared"))
    none = F.array().cast(SPANS)
    return (rows.select("row", "doc_id", "base").join(per_row, "row", "left")
            .select("doc_id", F.array_sort("base").alias("base"),
                    F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"),
                    *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_owned", "n_shared")]))


def _is(number: int):
    return lambda kind: F.when(kind == number, kind)


def digests(found: DataFrame) -> DataFrame:
    """The spans as counts and text: n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_shared."""
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _is(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), "n_owned", "n_shared")


def mask(docs: DataFrame, owner: str = "source", repository: str = "lang", id_col: str = "doc_id", text: str = "text",
         length: str = "n_chars") -> DataFrame:
    """The rows with all their columns, each secret replaced by MASK and `length`, if there is such a column, counted anew.

    Rows without secrets stay as they are. Overlapping spans are masked as one. A text that repeats under an id is masked in
    each of its rows: spans belong to (id, text).
    """
    here = docs.select(ref(id_col).alias("_id"), ref(text).alias("_text"), ref(owner).alias("_owner"),
                       ref(repository).alias("_repository"), F.xxhash64(ref(text)).alias("_hash"))
    keyed = here.select(F.struct("_id", "_hash").alias("_key"), "_text", "_owner", "_repository")
    key, digest, spans = (unused(docs, name) for name in ("_key", "_digest", "_spans"))
    found = (find_secrets(keyed, "_owner", "_repository", "_key", "_text").where(F.size("spans") > 0)
             .groupBy("doc_id").agg(F.max(F.transform("spans", lambda x: F.struct(
                 x["start"].alias("start"), x["end"].alias("end")))).alias(spans)))
    named = found.select(F.col("doc_id._id").alias(key), F.col("doc_id._hash").alias(digest), spans)
    joined = docs.join(named, ref(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(ref(text)) == F.col(digest)), "left")

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(ref(text), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit(MASK))).otherwise(state["out"]).alias("out"))

    rest = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(
        s["out"], F.substring(ref(text), s["at"] + 1, F.char_length(ref(text)))))
    new = unused(docs, "_masked")
    masked = joined.withColumn(new, F.when(F.col(spans).isNull(), ref(text)).otherwise(rest))
    return masked.select(*[
        ref(new).alias(c) if c == text else F.when(F.col(spans).isNull(), ref(c)).otherwise(F.char_length(new))
        .cast(docs.schema[c].dataType).alias(c) if c == length else ref(c) for c in docs.columns])

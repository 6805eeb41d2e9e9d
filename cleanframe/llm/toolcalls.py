"""Tool calls of conversations and their results, in DataFrame functions alone.

An assistant message may hold {"tool_calls": [{"id", "name", "arguments"}, ...]}, a tool message {"tool_call_id", "content"}. A
call whose arguments hold the text "$x" needs the result of the call x of its conversation.

Calls and results are joined by (conversation, id). Calls are ordered by levels: a call without needs has level 0, any other one
more than the highest of those it needs, so (level, turn, place) is a topological order. Calls with one need form chains, whose
ends are found by pointer doubling in rounds that grow with the logarithm of the longest one; calls with several needs are then settled
in rounds of their own, as many as such calls follow each other. Calls that remain need each other. Arguments are parsed as variants,
whose objects have sorted keys: the canonical JSON is written from them, and they are checked against the tool's schema from the
outside in. Each step checks the values of one depth, as rows, and pairs what they hold with its schema, so there are as many steps as
the deepest schema has levels. Keywords of a schema that are not checked here are reported, not passed over.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import ref
from cleanframe.plans.storage import Scratch, new_folder, stored

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: JSON types of a variant's types, by how these begin.
JSON_TYPES = [("BIGINT", "integer"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("FLOAT", "number"), ("STRING", "string"),
              ("BOOLEAN", "boolean"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null")]
#: The keywords that are checked, with the JSON types that their values may have.
KEYWORDS = {"type": ["string", "array"], "required": ["array"], "properties": ["object"], "additionalProperties": ["boolean", "object"],
            "items": ["boolean", "object"], "enum": ["array"]} | dict.fromkeys(
    ["minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"], ["integer", "number"]) | dict.fromkeys(
    ["minLength", "maxLength", "minItems", "maxItems"], ["integer"])
#: Keywords that no value can break; const may have any value.
FREE = ["const", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment",
        "$defs", "definitions"]
#: A string of a JSON text, with the colon after it if it is a key.
JSON_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?+'


def read_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, call_id, name, arguments): the calls of assistant messages, equal ones once."""
    parsed = messages.where("role = 'assistant'").select("conv_id", "turn", F.from_json("text", CALLS).alias("m"))
    one = parsed.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "call"))
    return one.select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"),
                      F.col("call.arguments").alias("arguments")).distinct()


def read_results(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, result, results): the first result of each call, and how many there are."""
    parsed = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("m"))
    named = parsed.where("m.tool_call_id IS NOT NULL").select(
        "conv_id", F.col("m.tool_call_id").alias("call_id"), F.struct("turn", F.col("m.content").alias("content")).alias("r"))
    return (named.distinct().groupBy("conv_id", "call_id").agg(F.min("r").alias("r"), F.count("*").alias("results"))
            .select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), "results"))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that a topological order holds; `needs` has (conv_id, call_id, need), where both
    are among `calls`. Calls in a circle, and those that need them, are left out."""
    scratch = Scratch(calls.sparkSession, "levels")
    key = ["conv_id", "call_id"]
    needs = scratch.put(needs.distinct())
    counted = scratch.put(needs.groupBy(*key).agg(F.count("*").alias("needs"), F.min("need").alias("need")))
    roots = calls.join(counted, key, "left_anti").select(*key)
    forks = counted.where("needs > 1").select(*key)
    single = _chains(scratch, counted.where("needs = 1").select(*key, "need"))
    found = _forks(scratch, needs.join(forks, key, "left_semi"), roots, forks, single)
    ends = found.unionByName(roots.withColumn("level", F.lit(0))).select("conv_id", F.col("call_id").alias("anchor"), "level")
    behind = single.where("NOT open").join(ends, ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("distance")).cast("int").alias("level"))
    out = scratch.put(found.unionByName(roots.withColumn("level", F.lit(0))).unionByName(behind))
    scratch.clear(out)
    return out


def _chains(scratch: Scratch, single: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, distance, open): for calls with one need, the call at the end of the chain of such needs, which has none
    or several, and how far it is.

    A call points to what it needs, then to where that points, and so on, twice as far in each round. A round that brings no
    call to an end leaves only calls that never come to one, as they lead into a circle; they stay `open`.
    """
    at = single.select("conv_id", F.col("call_id").alias("anchor"), F.lit(True).alias("there"))
    state = scratch.put(single.withColumnRenamed("need", "anchor").join(at, ["conv_id", "anchor"], "left").select(
        "conv_id", "call_id", "anchor", F.lit(1).alias("distance"), F.coalesce("there", F.lit(False)).alias("open")))
    left = state.where("open").count()
    while left:
        ahead = state.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("to"), F.col("distance").alias("more"),
                             F.col("open").alias("still"))
        jumped = state.where("open").join(ahead, ["conv_id", "anchor"]).select(
            "conv_id", "call_id", F.col("to").alias("anchor"), (F.col("distance") + F.col("more")).alias("distance"), F.col("still").alias("open"))
        moved = scratch.put(state.where("NOT open").unionByName(jumped))
        scratch.drop(state)
        state, before, left = moved, left, moved.where("open").count()
        if left == before:
            break
    return state


def _forks(scratch: Scratch, needs: DataFrame, roots: DataFrame, forks: DataFrame, single: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls with several needs. Each need is followed along its chain to a call without needs, which
    gives a height, or to another fork. A round of joins settles the forks that wait for no other one."""
    key = ["conv_id", "call_id"]
    chain = single.where("NOT open").select("conv_id", F.col("call_id").alias("need"), "anchor", "distance")
    followed = needs.join(chain, ["conv_id", "need"], "left").select(
        *key, F.coalesce("anchor", "need").alias("anchor"), (F.coalesce("distance", F.lit(0)) + 1).alias("height"))
    settled = roots.select("conv_id", F.col("call_id").alias("anchor"), F.lit(0).alias("level"))
    folder, waiting = new_folder(scratch.spark, "forks"), scratch.put(followed)
    scratch.put(forks.withColumn("level", F.lit(0)).limit(0)).write.mode("append").parquet(folder)
    while True:
        # A need that is settled has no anchor any more, just a height.
        reached = waiting.join(settled.withColumn("there", F.lit(True)), ["conv_id", "anchor"], "left").select(
            *key, F.when(F.col("there").isNull(), F.col("anchor")).alias("anchor"), (F.col("height") + F.coalesce("level", F.lit(0))).alias("height"))
        merged = scratch.put(reached.groupBy(*key, "anchor").agg(F.max("height").alias("height")))
        front = scratch.put(merged.groupBy(*key).agg(F.max("height").cast("int").alias("level"), F.count("anchor").alias("open"))
                            .where("open = 0").select(*key, "level"))
        scratch.drop(waiting)
        if front.isEmpty():
            break
        front.write.mode("append").parquet(folder)
        waiting = scratch.put(merged.join(front, key, "left_anti"))
        settled = front.select("conv_id", F.col("call_id").alias("anchor"), "level")
        scratch.drop(merged)
    return scratch.spark.read.schema(front.schema).parquet(folder)


def json_type(variant: Column) -> Column:
    kind = F.schema_of_variant(variant)
    out = F.lit("other")
    for start, name in reversed(JSON_TYPES):
        out = F.when(kind.startswith(start), name).otherwise(out)
    return out


def fields(variant: Column) -> Column:
    """An object's fields, NULL for anything else."""
    return F.when(json_type(variant) == "object", F.try_variant_get(variant, "$", "map<string,variant>"))


def elements(variant: Column) -> Column:
    """An array's elements, NULL for anything else."""
    return F.when(json_type(variant) == "array", F.try_variant_get(variant, "$", "array<variant>"))


def rule(node: Column, keyword: str) -> Column:
    return F.try_element_at(node["rules"], F.lit(keyword))


def same_value(a: Column, b: Column) -> Column:
    numbers = json_type(a).isin("integer", "number") & json_type(b).isin("integer", "number")
    return (F.to_json(a) == F.to_json(b)) | (numbers & ~(json_type(a).eqNullSafe("integer") & json_type(b).eqNullSafe("integer"))
                                             & (F.try_variant_get(a, "$", "double") == F.try_variant_get(b, "$", "double")))


def opened(nodes: DataFrame) -> DataFrame:
    """Values (row, path, value, schema), with what they and their schemas hold."""
    return nodes.select("row", F.struct(
        "path", "value", json_type(F.col("value")).alias("type"), fields(F.col("value")).alias("fields"),
        elements(F.col("value")).alias("elements"), F.to_json("schema").alias("schema"), fields(F.col("schema")).alias("rules")).alias("node"))


def below(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def node_errors(node: Column) -> Column:
    """What is wrong with one value, without what it holds."""
    kind, value, path = node["type"], node["value"], node["path"]
    no = F.array().cast("array<string>")

    def found(wrong: Column, label: str) -> Column:
        return F.when(wrong, F.array(F.concat(F.lit(f"{label}:"), path))).otherwise(no)

    wanted = F.when(json_type(rule(node, "type")) == "array", F.try_variant_get(rule(node, "type"), "$", "array<string>")).otherwise(
        F.array(F.try_variant_get(rule(node, "type"), "$", "string")))
    double = F.try_variant_get(value, "$", "double")
    whole = (kind == "number") & (double == F.floor(double))
    fits = (F.exists(wanted, lambda t: t.eqNullSafe(kind)) | ((kind == "integer") & F.exists(wanted, lambda t: t.eqNullSafe("number")))
            | (F.coalesce(whole, F.lit(False)) & F.exists(wanted, lambda t: t.eqNullSafe("integer"))))
    allowed = F.create_map(*[x for k, types in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, types)))])
    strange = F.filter(F.map_entries(node["rules"]), lambda e: ~e["key"].isin(FREE) & ~F.coalesce(F.array_contains(
        F.try_element_at(allowed, e["key"]), json_type(e["value"])), F.lit(False)))

    def bound(keyword: str, breaks) -> Column:
        limit, number = rule(node, keyword), kind.isin("integer", "number") & json_type(rule(node, keyword)).isin("integer", "number")
        exact = (kind == "integer") & (json_type(limit) == "integer")
        long = [F.try_variant_get(x, "$", "long") for x in (value, limit)]
        return found(number & F.when(exact, breaks(*long)).otherwise(breaks(double, F.try_variant_get(limit, "$", "double"))), keyword)

    def length(keyword: str, size: Column, breaks) -> Column:
        return found(breaks(size, F.try_variant_get(rule(node, keyword), "$", "long")), keyword)

    chars = F.when(kind == "string", F.char_length(F.try_variant_get(value, "$", "string")))
    count = F.when(node["elements"].isNotNull(), F.size(node["elements"]))
    required = F.coalesce(F.try_variant_get(F.when(json_type(rule(node, "required")) == "array", rule(node, "required")),
                                            "$", "array<string>"), no)
    missing = F.transform(F.filter(required, lambda k: ~F.map_contains_key(node["fields"], k)),
                          lambda k: F.concat(F.lit("missing:"), below(path, k)))
    less, more = (lambda a, b: a < b), (lambda a, b: a > b)
    checked = F.concat(
        found(rule(node, "type").isNotNull() & ~fits, "type"),
        found(~F.exists(elements(rule(node, "enum")), lambda e: same_value(e, value)), "enum"),
        found(~same_value(rule(node, "const"), value), "const"),
        bound("minimum", less), bound("maximum", more), bound("exclusiveMinimum", lambda a, b: a <= b),
        bound("exclusiveMaximum", lambda a, b: a >= b), length("minLength", chars, less), length("maxLength", chars, more),
        length("minItems", count, less), length("maxItems", count, more), F.coalesce(missing, no),
        F.transform(strange, lambda e: F.concat(F.lit("unsupported:"), e["key"])))
    return F.when(node["rules"].isNotNull(), checked).otherwise(
        F.when(node["schema"] == "true", no).when(node["schema"] == "false", F.array(F.concat(F.lit("unknown:"), path)))
        .otherwise(F.array(F.lit("bad schema"))))


def held_by(node: Column) -> Column:
    """The values (path, value, schema) that an object or array holds, if there is a schema for them."""
    none = F.array().cast("array<struct<path:string,value:variant,schema:variant>>")
    properties = fields(rule(node, "properties"))
    of_fields = F.transform(F.map_entries(node["fields"]), lambda e: F.struct(
        below(node["path"], e["key"]).alias("path"), e["value"].alias("value"),
        F.coalesce(F.try_element_at(properties, e["key"]), rule(node, "additionalProperties")).alias("schema")))
    of_elements = F.transform(node["elements"], lambda v, i: F.struct(
        F.concat(node["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("value"), rule(node, "items").alias("schema")))
    return F.filter(F.coalesce(of_fields, of_elements, none), lambda n: n["schema"].isNotNull())


def with_errors(calls: DataFrame) -> DataFrame:
    """`calls` with the column checked: sorted errors of `arguments` (text) against `schema` (text); `known` says whether the tool has
    one and `row` tells calls apart. A round checks the values of one depth, a row each, and ends where no schema goes deeper."""
    spark = calls.sparkSession
    value, schema = F.try_parse_json("arguments"), F.try_parse_json("schema")
    no_array = F.array().cast("array<string>")
    outer = (F.when(~F.coalesce("known", F.lit(False)), F.array(F.lit("no schema")))
             .when(json_type(schema).eqNullSafe("object") == F.lit(False), F.array(F.lit("bad schema")))
             .when(json_type(value).eqNullSafe("object") == F.lit(False), F.array(F.lit("no object"))))
    scratch, folder = Scratch(spark, "checks"), new_folder(spark, "errors")
    nodes = calls.where(outer.isNull()).select("row", F.lit("").alias("path"), value.alias("value"), schema.alias("schema"))
    for depth in count():
        level = scratch.put(nodes)
        if depth and level.isEmpty():
            break
        node = opened(level)
        node.select("row", F.explode(node_errors(F.col("node"))).alias("error")).distinct().write.mode("append").parquet(folder)
        nodes = node.select("row", F.inline(held_by(F.col("node"))).alias("path", "value", "schema"))
    scratch.clear()
    errors = spark.read.schema("row long, error string").parquet(folder).groupBy("row").agg(F.array_sort(F.collect_set("error")).alias("_errors"))
    return (calls.join(errors, "row", "left").withColumn("checked", F.coalesce(outer, F.col("_errors"), no_array)).drop("_errors"))


def references(arguments: Column) -> Column:
    """x of all string values "$x" of the arguments (text), at any depth."""
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(arguments)), F.lit(JSON_STRING), F.lit(0))
    quoted = F.filter(tokens, lambda t: t.startswith('"$') & ~t.endswith(":"))
    return F.array_distinct(F.transform(quoted, lambda t: F.substring(
        F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0], 2, 1 << 30)))


def link_tool_calls(messages: DataFrame, schemas: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """One row per call, and per result without a call: conv_id, call_id, turn, place, name, level, result_turn, results, status,
    errors, canonical.

    `schemas` has (name, schema), the schema as JSON text; of several for a name the smallest counts. status is `linked`, `no
    result`, `early result` (not after the call), `repeated` (a call of the conversation with that id comes before it), `circle`
    or `orphan` (a result without call). errors lists what is wrong with the arguments, as keyword:path (`missing` and
    `unknown` for required and refused fields), `unsupported:keyword` for keywords of their schemas that are not checked, and
    `unresolved:x` for needs without call, joined by commas. canonical is JSON with sorted keys, without blanks and without what is NULL.
    Messages that repeat in whole count once. Text that is not such JSON, NULL texts and NULL roles hold no calls. Calls
    without id are listed, never linked. NULL conversations are one conversation whose calls are never linked.
    """
    named = messages.select(ref(conversation).alias("conv_id"), ref(turn).alias("turn"), ref(role).alias("role"), ref(text).alias("text"))
    key = ["conv_id", "call_id"]
    place = F.struct("turn", "place", "name", "arguments")
    calls = stored(read_calls(named).withColumn("row", F.monotonically_increasing_id()))
    results = stored(read_results(named))
    firsts = calls.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("calls"))
    marked = calls.join(firsts, key, "left").withColumn(
        "repeated", F.coalesce((F.col("calls") > 1) & ~place.eqNullSafe(F.col("first")), F.lit(False)))
    needs = calls.select(*key, F.explode(references(F.col("arguments"))).alias("need"))
    there = firsts.select("conv_id", F.col("call_id").alias("need"))
    ordered = levels(firsts.select(*key).where("conv_id IS NOT NULL AND call_id IS NOT NULL"), stored(needs.join(there, ["conv_id", "need"])))
    unresolved = (needs.join(there, ["conv_id", "need"], "left_anti").groupBy(*key)
                  .agg(F.array_sort(F.collect_set(F.concat(F.lit("unresolved:"), "need"))).alias("unresolved")))
    tools = stored(schemas.groupBy("name").agg(F.min("schema").alias("schema")).withColumn("known", F.lit(True)))
    errors = F.concat("checked", F.coalesce("unresolved", F.array().cast("array<string>")))
    status = (F.when(F.col("repeated"), "repeated").when(F.col("level").isNull() & F.col("call_id").isNotNull()
                                                         & F.col("conv_id").isNotNull(), "circle")
              .when(F.col("result_turn").isNull(), "no result").when(F.col("result_turn") <= F.col("turn"), "early result")
              .otherwise("linked"))
    canonical = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name",
                                   F.when(F.col("status") == "linked", F.col("result")).alias("result")))
    tested = with_errors(stored(marked.join(tools, "name", "left"))).drop("schema", "known", "row")
    linked = (tested.join(results, key, "left").join(ordered, key, "left").join(unresolved, key, "left").withColumn("status", status)
              .select("conv_id", "call_id", "turn", "place", "name", "level", "result_turn", F.coalesce("results", F.lit(0)).alias("results"),
                      "status", F.array_join(errors, ",").alias("errors"), canonical.alias("canonical")))
    orphans = results.join(firsts.select(*key), key, "left_anti").select(
        "conv_id", "call_id", F.lit(None).cast(calls.schema["turn"].dataType).alias("turn"), F.lit(None).cast("int").alias("place"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), "result_turn", "results",
        F.lit("orphan").alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), "result")).alias("canonical"))
    return linked.unionByName(orphans)

"""One query per operator over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.llm import chunks, langid, merkle, middle, secrets, toxicity
from cleanframe.llm.common import documents, folds
from cleanframe.llm.decontaminate import contaminated
from cleanframe.llm.jaccard import jaccard_groups
from cleanframe.llm.minhash import minhash_groups
from cleanframe.llm.packing import pack_documents
from cleanframe.llm.repetition import repetition
from cleanframe.llm.separators import token_counts, write_tokens
from cleanframe.llm.shingles import Rule
from cleanframe.llm.toolcalls import link_tool_calls
from cleanframe.llm.tokens import MANY_LANGUAGES, VOCABULARY
from cleanframe.plans.storage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return add


@query()
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    field = langid.fit(docs, folds(F.col("doc_id"), 4) != 2)
    return langid.identify(docs, field).select(
        "doc_id", F.coalesce(folds(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixed")


@query()
def op2_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "tokens")
    write_tokens(documents(spark, folder), public_tokenizers.path(MANY_LANGUAGES), files)
    shard = F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("shard")
    return token_counts(spark, files).select(shard, "document", "start", "n_tokens", "closed")


@query()
def op3_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeated_spans(documents(spark, folder))


@query()
def op4_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(documents(spark, folder))


TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "after": {"type": "string"}},
               "required": ["query", "limit"], "additionalProperties": False},
    "lookup": {"properties": {"query": {"type": "string"}, "limit": {"type": "number"}}, "required": ["query"],
               "additionalProperties": False},
    "calculate": {"properties": {"limit": {"type": "integer"}}, "required": ["limit"]},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The test conversations hold no tools, so each assistant turn becomes a call made from its text, and each user turn the
    result of a call of the turn before. Some calls need an earlier one, some break their schema."""
    name = F.element_at(F.array(*[F.lit(n) for n in [*TOOLS, "translate"]]), F.pmod(F.col("turn"), F.lit(4)).cast("int") + 1)
    size = F.char_length("text")
    arguments = F.struct(
        F.when(size % 7 != 0, F.md5(F.col("text").cast("binary"))).alias("query"),
        F.when(size % 5 != 0, size).alias("limit"), F.when(size % 5 == 0, size.cast("string")).alias("LIMIT"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("$c"), (F.col("turn") - 2).cast("string"))).alias("after"))
    written = F.regexp_replace(F.to_json(arguments), "LIMIT", "limit")
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), F.col("turn").cast("string"), F.lit('","name":"'), name,
                    F.lit('","arguments":'), written, F.lit("}]}"))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"),
                                F.md5(F.col("text").cast("binary")).alias("content")))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    return conversations.where("role IN ('assistant', 'user')").select(
        "conv_id", "turn", role.alias("role"), F.when(F.col("role") == "user", result).otherwise(call).alias("text"))


TOOLS_SQL = """
    WITH c AS (SELECT DISTINCT conv_id, turn, role, md5(text) AS h, length(text) AS n FROM conversations),
    a AS (SELECT conv_id, turn, 'c' || turn AS call_id, ['search', 'lookup', 'calculate', 'translate'][turn % 4 + 1] AS name,
          n % 7 <> 0 AS has_query, n % 5 = 0 AS textual, turn >= 2 AS has_after, h, n FROM c WHERE role = 'assistant'),
    r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, min(h) AS result, count(DISTINCT h) AS results
          FROM c WHERE role = 'user' GROUP BY conv_id, turn),
    g AS (SELECT conv_id, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run, turn FROM a),
    l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM g),
    j AS (SELECT a.*, CAST(l.level AS INTEGER) AS level, r.result_turn, r.result, r.results, p.turn IS NULL AND a.has_after AS lost
          FROM a JOIN l USING (conv_id, turn) LEFT JOIN r USING (conv_id, call_id)
          LEFT JOIN a p ON p.conv_id = a.conv_id AND p.turn = a.turn - 2)
    SELECT conv_id, call_id, turn, 0 AS place, name, level, result_turn, coalesce(results, 0) AS results,
        CASE WHEN result_turn IS NULL THEN 'no result' ELSE 'linked' END AS status,
        array_to_string(list_filter([
            CASE WHEN name = 'translate' THEN 'no schema' END,
            CASE WHEN name IN ('search', 'lookup') AND NOT has_query THEN 'missing:query' END,
            CASE WHEN name <> 'translate' AND textual THEN 'type:limit' END,
            CASE WHEN name = 'lookup' AND has_after THEN 'unknown:after' END,
            CASE WHEN lost THEN 'unresolved:c' || (turn - 2) END], lambda x: x IS NOT NULL), ',') AS errors,
        '{"arguments":{' || array_to_string(list_filter([
            CASE WHEN has_after THEN '"after":"$c' || (turn - 2) || '"' END,
            CASE WHEN textual THEN '"limit":"' || n || '"' ELSE '"limit":' || n END,
            CASE WHEN has_query THEN '"query":"' || h || '"' END], lambda x: x IS NOT NULL), ',')
        || '},"id":"' || call_id || '","name":"' || name || '"' || coalesce(',"result":"' || result || '"', '') || '}' AS canonical
    FROM j
    UNION ALL
    SELECT conv_id, call_id, NULL, NULL, NULL, NULL, result_turn, results, 'orphan', '',
        '{"id":"' || call_id || '","result":"' || result || '"}'
    FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = r.conv_id AND a.call_id = r.call_id)"""


@query(TOOLS_SQL)
def op5_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    schemas = spark.createDataFrame([(name, json.dumps(schema)) for name, schema in TOOLS.items()], "name string, schema string")
    return link_tool_calls(tool_messages(documents(spark, folder, "conversations")), schemas)


def _secret_matches(kind: str) -> str:
    pattern = secrets.PATTERNS_ALL[kind].replace("'", "''")
    return f"""SELECT doc_id, source, lang, {secrets.KINDS.index(kind)} AS no, '{kind}' AS kind,
        regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, string_split_regex(coalesce(text, ''), '{pattern}') AS p
        FROM documents"""


_ASSIGN = secrets.PATTERNS["assign"].replace("'", "''")
SECRETS_SQL = f"""
    WITH f AS ({" UNION ALL ".join(_secret_matches(k) for k in secrets.KINDS)}),
    i AS (SELECT doc_id, source, lang, no, kind, m, p, unnest(range(1, len(m) + 1)) AS i FROM f),
    s AS (SELECT doc_id, source, lang, no, kind, m[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM i),
    v AS (SELECT *, a + length(v) AS e, CASE WHEN no = 0 THEN regexp_extract(v, '{_ASSIGN}', 2) ELSE v END AS w FROM s),
    k AS (SELECT * FROM v WHERE CASE no WHEN 0 THEN length(w) >= 12 WHEN 1 THEN length(w) >= 18 WHEN 2 THEN length(w) >= 16
          ELSE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]')
               AND len(list_distinct(string_split(w, ''))) >= {secrets.DISTINCT_CHARACTERS} END),
    c AS (SELECT * FROM k WHERE no < 3 UNION ALL
          SELECT * FROM k x WHERE no = 3 AND NOT EXISTS (
              SELECT 1 FROM k b WHERE b.no < 3 AND b.doc_id = x.doc_id AND b.a < x.e AND x.a < b.e)),
    o AS (SELECT w, count(DISTINCT source) <= {secrets.MOST_OWNERS}
          AND count(DISTINCT (source, lang)) <= {secrets.MOST_REPOSITORIES} AS owned FROM c GROUP BY w),
    j AS (SELECT * FROM c JOIN o USING (w)),
    r AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access,
          count(*) FILTER (no = 2) AS n_hex,
          string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, no) FILTER (no < 3) AS b,
          string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, no) FILTER (no < 3 OR owned) AS spans,
          count(*) FILTER (owned) AS n_owned, count(*) FILTER (NOT owned) AS n_shared FROM j GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
        coalesce(n_shared, 0) AS n_shared
    FROM documents LEFT JOIN r USING (doc_id)"""


@query(SECRETS_SQL)
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(documents(spark, folder)))


@query()
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(documents(spark, folder), documents(spark, folder, "benchmark"))


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, documents(spark, folder, "labels"), folds(F.col("doc_id"), 3) != 1)


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    scored = toxicity.classify(docs, toxicity_model(spark, folder, docs))
    return scored.select("doc_id", F.coalesce(folds(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), public_tokenizers.path(VOCABULARY))


@query()
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(documents(spark, folder), Rule(words=4, num=85, den=100))


#: The CRC-32 of a value's decimal text, bit by bit.
CRC_SQL = """xor(list_reduce(flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295)"""


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


MERKLE_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
            {_leaf_sql(f"(n_chars + CASE WHEN {CRC_SQL.format('doc_id')} % 7 = 0 THEN 1 ELSE 0 END)")} AS seen FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
          row_number() OVER () AS row FROM d),
    t AS (SELECT lang, 0 AS level, pos, leaf AS digest, n FROM p UNION ALL
          SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1
          GROUP BY lang, level, pos // 2, n),
    s AS (SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
          FROM t WHERE n = 1),
    u AS (SELECT 0 AS level, pos, subroot AS digest, n FROM s UNION ALL
          SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
    g AS (SELECT row, lang, level, p.pos AS pos, seen AS digest, height FROM (SELECT row, lang, 0 AS level, pos, seen FROM p) p
          JOIN (SELECT lang AS l, height FROM s) h ON p.lang IS NOT DISTINCT FROM h.l UNION ALL
          SELECT g.row, g.lang, g.level + 1, g.pos // 2,
                 sha256(CASE WHEN g.pos % 2 = 1 THEN o.digest || g.digest ELSE g.digest || coalesce(o.digest, '') END), g.height
          FROM g LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM g.lang AND o.level = g.level AND o.pos = xor(g.pos, 1) WHERE g.level < g.height),
    b AS (SELECT g.row, s.pos AS place, 0 AS level, s.pos AS pos, g.digest FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang WHERE g.level = g.height UNION ALL
          SELECT b.row, b.place, b.level + 1, b.pos // 2,
                 sha256(CASE WHEN b.pos % 2 = 1 THEN o.digest || b.digest ELSE b.digest || coalesce(o.digest, '') END)
          FROM b LEFT JOIN u o ON o.level = b.level AND o.pos = xor(b.pos, 1) WHERE b.level < (SELECT max(level) FROM u)),
    q AS (SELECT g.row, 0 AS part, g.level, o.digest FROM g JOIN t o ON o.lang IS NOT DISTINCT FROM g.lang AND o.level = g.level AND o.pos = xor(g.pos, 1)
          UNION ALL SELECT b.row, 1, b.level, o.digest FROM b JOIN u o ON o.level = b.level AND o.pos = xor(b.pos, 1)),
    r AS (SELECT row, string_agg(digest, '' ORDER BY part, level) AS siblings FROM q GROUP BY row)
    SELECT p.doc_id, p.leaf, s.subroot, z.digest AS root, sha256(coalesce(r.siblings, '')) AS proof_sha256, e.digest AS folded_root,
        e.digest = z.digest AS verified
    FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u z ON z.n = 1 JOIN b e ON e.row = p.row AND e.level = (SELECT max(level) FROM u)
    LEFT JOIN r ON r.row = p.row"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return merkle.fold(merkle.manifest(documents(spark, folder), seen={"n_chars": F.col("n_chars") + F.when(changed, 1).otherwise(0)}))


@query()
def op12_minhash_hamming(spark: SparkSession, folder: str) -> DataFrame:
    groups = minhash_groups(documents(spark, folder), Rule(words=5, num=85, den=100))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unit_sql(a: str, b: str) -> str:
    return f"array_to_string(u[{a}:{b}], '')"


MIDDLE_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
          {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
    c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
    f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, {_unit_sql('1', 'a')} AS p, {_unit_sql('a + 1', 'b')} AS m,
          {_unit_sql('b + 1', 'n')} AS s FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
               ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
    FROM f"""


@query(MIDDLE_SQL)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = middle.fill_in_middle(documents(spark, folder))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

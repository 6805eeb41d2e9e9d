"""Duplicate detection and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cleaning import clean_sql
from catalog.registry import GAPS_TEXT, gaps_text, query, table
from cleanframe.functions import similarity
from cleanframe.operators.dedup import blocks, classify, components, detect, exact, review
from cleanframe.plans.skew import spread_lookup
from cleanframe.plans.storage import cut_lineage

PART_KEY, PART_EXACT, PART_SIMILAR = "p_name", ["p_brand"], ["p_type", "p_retailprice"]


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def dedup_exact(spark, d):
    return exact.remove_identical_rows(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")


@query("dedup_exact_nulls", f"""
    SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority FROM {GAPS_TEXT}
    GROUP BY o_orderstatus, o_orderpriority, CASE WHEN o_orderpriority IS NULL THEN o_orderkey END""")
def dedup_exact_nulls(spark, d):
    df = gaps_text(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return exact.remove_identical_rows(df, "o_orderkey")


def block_sql(key: str, source: str) -> str:
    return f"""
    WITH c AS (SELECT {key} AS key, count(*) AS n FROM {source} GROUP BY 1),
    r AS (SELECT key, n, row_number() OVER (ORDER BY key) - 1 AS rank, lead(n, 1, 0) OVER (ORDER BY key) AS after FROM c)
    SELECT rank, key, n AS n_rows, CAST(n * (n - 1) / 2 AS DOUBLE) AS pairs_inside,
        CAST(n * after AS DOUBLE) AS pairs_with_next FROM r"""


def _sizes(df, key):
    return blocks.block_sizes(df, key).select(
        "rank", "key", "n_rows", *[F.col(c).cast("double").alias(c) for c in ("pairs_inside", "pairs_with_next")])


@query("block_sizes_text", block_sql(clean_sql("p_name"), "part"))
def block_sizes_text(spark, d):
    return _sizes(table(spark, d, "part"), "p_name")


@query("block_sizes_number", block_sql("c_acctbal", "customer"))
def block_sizes_number(spark, d):
    return _sizes(table(spark, d, "customer"), "c_acctbal")


def _neighbours(spark, d, *columns):
    """Each part beside the part with the next key."""
    part = table(spark, d, "part")
    first = part.select("p_partkey", *[F.col(c).alias(f"{c}_a") for c in columns])
    second = part.select((F.col("p_partkey") - 1).alias("p_partkey"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return first.join(second, "p_partkey")


PART_PAIRS = "part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query("compare_exact", f"""
    SELECT a.p_partkey, CAST(a.p_brand = b.p_brand AS DOUBLE) AS level FROM {PART_PAIRS}""")
def compare_exact(spark, d):
    return _neighbours(spark, d, "p_brand").select(
        "p_partkey", similarity.exact_level(F.col("p_brand_a"), F.col("p_brand_b")).alias("level"))


@query("compare_number", f"""
    SELECT a.p_partkey, round(greatest(0, 1 - greatest(abs(a.p_size - b.p_size) - 10, 0) / 20.0::DOUBLE), 6) AS level
    FROM {PART_PAIRS}""")
def compare_number(spark, d):
    return _neighbours(spark, d, "p_size").select(
        "p_partkey", F.round(similarity.number_level(F.col("p_size_a"), F.col("p_size_b")), 6).alias("level"))


@query("compare_text", f"""
    SELECT a.p_partkey, CASE WHEN 1 - damerau_levenshtein(a.p_name, b.p_name)::DOUBLE
        / greatest(len(a.p_name), len(b.p_name)) >= 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS level FROM {PART_PAIRS}""")
def compare_text(spark, d):
    return _neighbours(spark, d, "p_name").select(
        "p_partkey", similarity.text_level(F.col("p_name_a"), F.col("p_name_b")).alias("level"))


@query("compare_date", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN o_orderdate = l_shipdate THEN 1.0::DOUBLE
            WHEN year(o_orderdate) = year(l_shipdate) AND (
                month(o_orderdate) = day(l_shipdate) AND day(o_orderdate) = month(l_shipdate)
                OR day(o_orderdate) = day(l_shipdate) AND (month(o_orderdate), month(l_shipdate))
                    IN ((6, 7), (7, 6), (9, 10), (10, 9))) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS level
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def compare_date(spark, d):
    pairs = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                        similarity.date_level(F.col("o_orderdate"), F.col("l_shipdate")).alias("level"))


# All candidate pairs of parts with their similarities, by comparing every pair.
PART_DIMS = ["p_name", "p_brand", "p_type", "p_retailprice"]
PART_ONCE = """(SELECT min(p_partkey) AS p_partkey, * EXCLUDE (p_partkey) FROM part GROUP BY ALL)"""


def part_vectors_sql(source: str) -> str:
    return f"""
    WITH RECURSIVE c AS (SELECT p_partkey AS id, {clean_sql('p_name')} AS k, {clean_sql('p_brand')} AS b,
        {clean_sql('p_type')} AS t, p_retailprice AS x FROM {source}),
    r AS (SELECT *, dense_rank() OVER (ORDER BY k) AS rank FROM c),
    p AS (SELECT u.id AS ida, v.id AS idb, CAST(u.rank = v.rank AS DOUBLE) AS p_name, CAST(u.b = v.b AS DOUBLE) AS p_brand,
        CASE WHEN damerau_levenshtein(u.t, v.t) <= 0.25 * greatest(len(u.t), len(v.t)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
            AS p_type,
        round(greatest(0.0, 1 - greatest(abs(u.x - v.x) - 10, 0) / 20), 6) AS p_retailprice
        FROM r u JOIN r v ON v.rank IN (u.rank, u.rank + 1) AND (v.rank > u.rank OR v.id > u.id)),
    h AS (SELECT p_name, p_brand, p_type, p_retailprice, CAST(count(*) AS DOUBLE) AS pairs FROM p GROUP BY ALL)"""


def _part_vectors(spark, d):
    found = detect.pair_vectors(table(spark, d, "part"), PART_KEY, PART_EXACT, PART_SIMILAR, "p_partkey")
    return (found.groupBy("p_name", "p_brand", "p_type", F.round("p_retailprice", 6).alias("p_retailprice"))
            .agg(F.sum("pairs").cast("double").alias("pairs")))


@query("pair_vectors", f"{part_vectors_sql('part')} SELECT * FROM h")
def pair_vectors(spark, d):
    return _part_vectors(spark, d)


@query("pair_summaries", f"""{part_vectors_sql('part')} SELECT p_name, p_brand, p_type, CAST(count(*) AS DOUBLE) AS pairs,
    CAST(count(*) FILTER (p_retailprice > 1e-6) AS DOUBLE) AS near, round(sum(p_retailprice), 3) AS level_sum,
    round(sum(p_retailprice * p_retailprice), 3) AS level_squares FROM p GROUP BY ALL""")
def pair_summaries(spark, d):
    """By running sums over sorted prices, without looking at pairs."""
    found = detect.pair_summary(table(spark, d, "part"), PART_KEY, PART_EXACT, PART_SIMILAR, "p_partkey")
    return found.select("p_name", "p_brand", "p_type", F.col("pairs").cast("double"), F.col("near").cast("double"),
                        F.round("level_sum", 3).alias("level_sum"), F.round("level_squares", 3).alias("level_squares"))


def _score_sql(vector: str) -> str:
    return " + ".join(f"(z.m{i} - z.n{i}) * {vector}.{c} - (z.m{i} * z.m{i} - z.n{i} * z.n{i}) / 2"
                      for i, c in enumerate(PART_DIMS))


def two_means_sql(source: str, rounds: int = 12) -> str:
    """The clustering with its rounds written out, up to the last centres z; after the stop they stay as they are."""
    var = " + ".join(f"(sum(pairs * {c} * {c}) / sum(pairs) - pow(sum(pairs * {c}) / sum(pairs), 2))" for c in PART_DIMS)
    start = ", ".join([f"0.05::DOUBLE AS n{i}, 0.95::DOUBLE AS m{i}" for i in range(4)])
    parts = [f"z0 AS (SELECT {start}, false AS stop, 1e-4 * ({var}) / 4 AS tol FROM h)"]
    for r in range(1, rounds + 1):
        means = ", ".join(
            f"coalesce(sum(CASE WHEN NOT hit THEN pairs * {c} END) / sum(CASE WHEN NOT hit THEN pairs END), any_value(n{i})) AS a{i}, "
            f"coalesce(sum(CASE WHEN hit THEN pairs * {c} END) / sum(CASE WHEN hit THEN pairs END), any_value(m{i})) AS b{i}"
            for i, c in enumerate(PART_DIMS))
        keep = ", ".join(f"any_value(n{i}) AS n{i}, any_value(m{i}) AS m{i}" for i in range(4))
        shift = " + ".join(f"pow(a{i} - n{i}, 2) + pow(b{i} - m{i}, 2)" for i in range(4))
        choose = ", ".join(f"CASE WHEN stop THEN n{i} ELSE a{i} END AS n{i}, CASE WHEN stop THEN m{i} ELSE b{i} END AS m{i}"
                           for i in range(4))
        parts.append(f"s{r} AS (SELECT h.*, z.*, {_score_sql('h')} > 1e-9 AS hit FROM h, z{r - 1} z)")
        parts.append(f"t{r} AS (SELECT {means}, {keep}, any_value(stop) AS stop, any_value(tol) AS tol FROM s{r})")
        parts.append(f"z{r} AS (SELECT {choose}, stop OR {shift} <= tol AS stop, tol FROM t{r})")
    return f"{part_vectors_sql(source)}, {', '.join(parts)}, z AS (SELECT * FROM z{rounds})"


@query("classify_pairs", f"{two_means_sql('part')} SELECT h.*, {_score_sql('h')} > 1e-9 AS match FROM h, z")
def classify_pairs(spark, d):
    vectors = cut_lineage(_part_vectors(spark, d))
    return classify.classify(vectors, PART_DIMS, classify.two_means(vectors, PART_DIMS))


@query("components", """
    WITH s AS (SELECT doc_id, lang, coalesce(lag(lang) OVER (ORDER BY doc_id) <> lang
        OR lag(doc_id) OVER (ORDER BY doc_id) <> doc_id - 1, true) AS starts FROM documents)
    SELECT doc_id AS node, max(CASE WHEN starts THEN doc_id END) OVER (ORDER BY doc_id) AS component FROM s""")
def components_of_runs(spark, d):
    """Documents tied to the one with the next id when the language is the same: long paths."""
    documents = table(spark, d, "documents").select("doc_id", "lang")
    following = documents.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("doc_id").alias("dst"))
    edges = documents.join(following, ["doc_id", "lang"]).select(F.col("doc_id").alias("src"), "dst")
    alone = documents.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
    return components.connected_components(edges.unionByName(alone))


def _same_text(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text")
    first = documents.groupBy("text").agg(F.min("doc_id").alias("component"))
    labels = spread_lookup(documents, first, ["text"]).select("doc_id", "component")
    return documents, detect.number_clusters(labels, "doc_id")


SAME_TEXT = """
    WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1),
    g AS (SELECT text, first, row_number() OVER (ORDER BY first) AS group_id FROM f)"""


@query("cluster_table", f"{SAME_TEXT} SELECT doc_id, group_id, false AS delete FROM documents JOIN g USING (text)")
def cluster_table(spark, d):
    return _same_text(spark, d)[1]


@query("cluster_sizes", f"{SAME_TEXT} SELECT group_id, count(*) AS n_members FROM documents JOIN g USING (text) GROUP BY group_id")
def cluster_sizes(spark, d):
    return review.open_clusters(_same_text(spark, d)[1])


@query("cluster_show", f"""
    {SAME_TEXT} SELECT doc_id, text FROM documents JOIN g USING (text) WHERE group_id = 2 AND text LIKE '%a%'
    ORDER BY doc_id LIMIT 10""")
def cluster_show(spark, d):
    documents, clusters = _same_text(spark, d)
    return review.show_cluster(documents, clusters, 2, 0, 10, None, True, "a", "doc_id")


@query("dedup_auto", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_auto(spark, d):
    documents, clusters = _same_text(spark, d)
    return review.mark_and_resolve(documents, clusters, (), "doc_id").rows


@query("dedup_marked", f"""
    {SAME_TEXT} SELECT doc_id, text FROM documents WHERE doc_id NOT IN (
        SELECT doc_id FROM documents JOIN g USING (text) WHERE group_id = 1 AND doc_id > first)""")
def dedup_marked(spark, d):
    """All but the first member of the first cluster are marked, then the review ends."""
    documents, clusters = _same_text(spark, d)
    current = clusters.where(F.col("group_id") == review.next_group(clusters))
    first = current.agg(F.min("doc_id")).first()[0]
    marks = current.where(F.col("doc_id") > first).select("doc_id")
    return review.mark_and_finish(documents, clusters, marks, "doc_id").rows


@query("cluster_members", f"{SAME_TEXT} SELECT doc_id, text, group_id FROM documents JOIN g USING (text)")
def cluster_members(spark, d):
    return review.cluster_rows(*_same_text(spark, d), "doc_id")


@query("review_next", f"""
    {SAME_TEXT} SELECT doc_id, group_id, group_id = 1 AS delete FROM documents JOIN g USING (text)
    WHERE group_id > 1 OR doc_id > first""")
def review_next(spark, d):
    """The first cluster is closed with all but its first member marked; the review goes on with the others."""
    documents, clusters = _same_text(spark, d)
    current = clusters.where(F.col("group_id") == review.next_group(clusters))
    first = current.agg(F.min("doc_id")).first()[0]
    marks = current.where(F.col("doc_id") > first).select("doc_id")
    return review.mark_and_next(documents, clusters, marks, "doc_id").clusters


@query("find_duplicates", f"""
    {two_means_sql(PART_ONCE)},
    e AS (SELECT ida, idb FROM p, z WHERE {_score_sql('p')} > 1e-9),
    b AS (SELECT ida AS a, idb AS b FROM e UNION ALL SELECT idb, ida FROM e),
    reach AS (SELECT DISTINCT a AS node, a AS label FROM b UNION SELECT b.b, reach.label FROM reach JOIN b ON b.a = node),
    l AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
    SELECT node AS p_partkey, dense_rank() OVER (ORDER BY label) AS group_id, false AS delete FROM l""")
def find_duplicates(spark, d):
    found = detect.find_duplicates(table(spark, d, "part"), PART_KEY, PART_EXACT, PART_SIMILAR, "p_partkey")
    return found.clusters


@query("review_stay", f"""
    {SAME_TEXT} SELECT doc_id, group_id, group_id = 1 AND doc_id > first AS delete FROM documents JOIN g USING (text)""")
def review_stay(spark, d):
    """All but the first member of the first cluster are marked, and the review stays at that cluster."""
    documents, clusters = _same_text(spark, d)
    current = clusters.where(F.col("group_id") == review.next_group(clusters))
    first = current.agg(F.min("doc_id")).first()[0]
    marks = current.where(F.col("doc_id") > first).select("doc_id")
    return review.mark_and_stay(documents, clusters, marks, "doc_id").clusters

"""Duplicate detection against all-pairs brute force on small tables."""

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanframe.functions.similarity import edit_distance, text_level
from cleanframe.operators.dedup.blocks import block_sizes, dimensions, rank_rows
from cleanframe.operators.dedup.classify import Rule, two_means
from cleanframe.operators.dedup.components import connected_components
from cleanframe.operators.dedup.detect import find_duplicates, has_undecided, match_edges, pair_vectors
from cleanframe.operators.dedup.exact import remove_identical_rows
from cleanframe.operators.dedup import review
from cleanframe.operators.dedup.vectors import tuples_of, vector_counts
from cleanframe.plans.storage import cut_lineage
from tests.conftest import rows

SCHEMA = "id long, city string, name string, kind string, amount double, born timestamp_ntz"
NAMES = ["martha jones", "marhta jones", "martha jone", "peter smith", "petre smith", "pete smith", "anna", "anan",
         "anne", "bob", "x", "christopher columbus", "christofer columbus", "christopher colombus", "", None]


def people(n, seed, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        city = "hot town" if rng.random() < hot else rng.choice(["aachen", "bonn", "celle", "(x) bonn", "Essen", None])
        born = rng.choice([None, dt.datetime(2000, 3, 4), dt.datetime(2000, 4, 3), dt.datetime(2001, 6, 9),
                           dt.datetime(2001, 7, 9), dt.datetime(2002, 5, 5), dt.datetime(2002, 5, 5, 12)])
        out.append((i * 3 + 1, city, rng.choice(NAMES), rng.choice(["a", "b", "c", None]),
                    rng.choice([None, float("nan"), 1.0, 5.5, 18.0, 27.0, 90.0, 104.5]), born))
    return out


def clean(text):
    import re
    if text is None:
        return None
    text = re.sub(r"(\[.*?\]|\(.*?\)|\{.*?\})", "", text.lower())
    text = re.sub(r"[^ \-_A-Za-z0-9]+", "", text)
    return re.sub(r"\s\s+", " ", re.sub(r"[\-_]", " ", text)).strip()


def level(how, a, b):
    if a is None or b is None or a != a or b != b:
        return 0.0
    if how == "exact":
        return float(a == b)
    if how == "text":
        if not a or not b:
            return 0.0
        return float(1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.75)
    if how == "number":
        return max(0.0, 1 - max(abs(a - b) - 10, 0) / 20)
    if a == b:
        return 1.0
    swapped = a.year == b.year and a.month == b.day and a.day == b.month
    months = a.year == b.year and a.day == b.day and (a.month, b.month) in [(6, 7), (7, 6), (9, 10), (10, 9)]
    return 0.5 if swapped or months else 0.0


def brute(table, key, exact, similar):
    """Each candidate pair with its vector."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    hows = {"name": "text", "amount": "number", "born": "date", "city": "text", "kind": "text"}
    records = [{k: clean(v) if isinstance(v, str) else v for k, v in zip(names, r)} for r in table]
    records = [r for r in records if r[key] is not None]
    rank = {k: i for i, k in enumerate(sorted({r[key] for r in records}))}
    dims = [(c, "exact") for c in exact if c != key] + [(c, hows[c]) for c in similar]
    for a, b in itertools.combinations(records, 2):
        if abs(rank[a[key]] - rank[b[key]]) <= 1:
            yield a["id"], b["id"], (float(a[key] == b[key]), *[level(h, a[c], b[c]) for c, h in dims])


def lloyd(vectors):
    x = np.array(vectors)
    centres = np.array([[0.05] * x.shape[1], [0.95] * x.shape[1]])
    tol = 1e-4 * x.var(axis=0).mean()
    for _ in range(300):
        match = ((x - centres[0]) ** 2).sum(1) - ((x - centres[1]) ** 2).sum(1) > 1e-9
        if not match.any():
            return None, match
        new = np.array([x[~match].mean(0) if (~match).any() else centres[0], x[match].mean(0)])
        shift = ((new - centres) ** 2).sum()
        centres = new
        if shift <= tol:
            break
    return centres, ((x - centres[0]) ** 2).sum(1) - ((x - centres[1]) ** 2).sum(1) > 1e-9


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = defaultdict(set)
    for x in list(parent):
        found[find(x)].add(x)
    return sorted(sorted(g) for g in found.values())


COMPARISONS = [
    (["kind"], []),
    ([], ["name"]),
    (["kind"], ["name"]),
    ([], ["amount", "born"]),
    (["kind"], ["name", "amount", "born"]),
]


@pytest.mark.parametrize("exact,similar", COMPARISONS)
def test_vectors_equal_all_pairs(spark, exact, similar):
    table = people(120, 1)
    df = spark.createDataFrame(table, SCHEMA)
    got = {tuple(round(v, 9) for v in r[:-1]): int(r[-1])
           for r in pair_vectors(df, "city", exact, similar).collect()}
    want = Counter(tuple(round(v, 9) for v in vector) for _, _, vector in brute(table, "city", exact, similar))
    assert got == dict(want)


@pytest.mark.parametrize("exact,similar", COMPARISONS)
@pytest.mark.parametrize("seed", [3])
def test_clusters_equal_all_pairs(spark, exact, similar, seed):
    table = people(90, seed, hot=0.2)
    df = spark.createDataFrame(table, SCHEMA)
    result = find_duplicates(df, "city", exact, similar)
    kept = {r[0] for r in result.rows.select("id").collect()}
    pairs = list(brute([r for r in table if r[0] in kept], "city", exact, similar))
    _, match = lloyd([v for _, _, v in pairs])
    want = groups_of([(a, b) for (a, b, _), m in zip(pairs, match) if m])
    found = defaultdict(list)
    for r in result.clusters.collect():
        found[r["group_id"]].append(r["id"])
    assert sorted(sorted(g) for g in found.values()) == want
    assert sorted(found) == list(range(1, len(want) + 1))


def random_rule(rng, dims):
    """Any two centres: some columns speak against a match, and so may the key."""
    return Rule(tuple(rng.random() * 0.5 for _ in range(dims + 1)), tuple(rng.random() for _ in range(dims + 1)))


@pytest.mark.parametrize("seed", range(6))
def test_edges_for_any_rule(spark, seed):
    """The clusters of all matching pairs, also where agreement on a column speaks against a match."""
    rng = random.Random(seed)
    exact, similar = COMPARISONS[rng.randrange(1, len(COMPARISONS))]
    table = people(45, seed + 50, hot=0.3)
    df = spark.createDataFrame(table, SCHEMA)
    dims = dimensions(df, "city", exact, similar)
    rule = random_rule(rng, len(dims))
    rows_ranked = rank_rows(df, "id", "city", dims)
    tuples = cut_lineage(tuples_of(rows_ranked, dims))
    undecided = has_undecided(vector_counts(tuples, dims), dims, rule)
    labels = dict(connected_components(match_edges(tuples, dims, rule, undecided)).collect())
    of_rep = defaultdict(list)
    values = ["_rank", *[f"v{i}" for i in range(len(dims))]]
    rep_of = {tuple(r[c] for c in values): r["_rep"] for r in tuples.collect()}
    for r in rows_ranked.collect():
        of_rep[rep_of[tuple(r[c] for c in values)]].append(r["_id"])
    found = defaultdict(set)
    for rep, component in labels.items():
        found[component].update(of_rep[rep])
    pairs = list(brute(table, "city", exact, similar))
    want = groups_of([(a, b) for a, b, v in pairs if rule.score(v) > 1e-9])
    assert sorted(sorted(g) for g in found.values() if len(g) > 1) == want


def test_centres_equal_plain_lloyd(spark):
    rng = random.Random(5)
    vectors = [(rng.choice([0.0, 1.0]), rng.choice([0.0, 0.5, 1.0]), rng.random()) for _ in range(300)]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "a double, b double, c double, pairs int")
    rule = two_means(df, ["a", "b", "c"])
    centres, _ = lloyd(vectors)
    assert np.allclose([rule.no_match, rule.match], centres)


def test_no_match_gives_no_clusters(spark):
    df = spark.createDataFrame([(1, "a", "q"), (2, "b", "r"), (3, "c", "s")], "id long, k string, v string")
    assert not find_duplicates(df, "k", ["v"]).found()


def test_text_level_bounds(spark):
    words = ["abcd", "abdc", "ab", "ba", "kitten", "sitting", "martha", "marhta", "abcdefgh", "bacdfegh", "", None]
    pairs = list(itertools.product(words, words))
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, got in df.select("a", "b", text_level(F.col("a"), F.col("b"))).collect():
        assert got == level("text", a, b), (a, b)
    assert edit_distance("ca", "abc") == 2


def test_text_neighbours_miss_nothing(spark):
    from cleanframe.operators.dedup.neighbours import text_neighbours
    rng = random.Random(11)
    words = set()
    for _ in range(25):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        words.add(word)
        for _ in range(4):
            chars = list(word)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(chars))
                change = rng.choice("sidt")
                if change == "s":
                    chars[i] = rng.choice("abcd")
                elif change == "i":
                    chars.insert(i, rng.choice("abcd"))
                elif change == "d" and len(chars) > 1:
                    del chars[i]
                elif change == "t" and i + 1 < len(chars):
                    chars[i], chars[i + 1] = chars[i + 1], chars[i]
            words.add("".join(chars))
    values = [(rng.randrange(3), w) for w in sorted(words)]
    got = {tuple(r) for r in text_neighbours(spark.createDataFrame(values, "_rank long, v string"))
           .select("_rank", "v", "_rank_b", "b").collect()}
    want = {(ra, a, rb, b) for ra, a in values for rb, b in values if rb in (ra, ra + 1) and level("text", a, b)}
    assert got == want


def test_block_sizes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "B"), (3, "a"), (4, None), (5, "c")], "id long, k string")
    assert rows(block_sizes(df, "k")) == [(0, "a", 1, 0, 2), (1, "b", 2, 1, 2), (2, "c", 1, 0, 0)]


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 200)] + [(1000, 1001), (1002, 1001), (5000, 5000)]
    random.Random(1).shuffle(path)
    found = connected_components(spark.createDataFrame(path, "src long, dst long"))
    got = dict(found.collect())
    assert all(got[i] == 1 for i in range(1, 201)) and got[1002] == got[1001] == 1000 and got[5000] == 5000
    hub = [(0, i) for i in range(1, 500)]
    assert {r[1] for r in connected_components(spark.createDataFrame(hub, "src long, dst long")).collect()} == {0}


def test_identical_rows(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "a", 1), (4, "b", None), (5, "b", None), (6, "c", 2)],
                               "id long, a string, b int")
    once = remove_identical_rows(df)
    assert [r[0] for r in rows(once)] == [1, 4, 5, 6]
    assert rows(remove_identical_rows(once)) == rows(once)
    only_id = df.select("id")
    assert rows(remove_identical_rows(only_id)) == rows(only_id)


@pytest.fixture
def clustered(spark):
    table = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "id long, name string")
    clusters = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 1, False), (4, 2, False), (5, 2, False)],
                                     "id long, group_id long, delete boolean")
    return table, clusters


def test_review_actions(clustered):
    table, clusters = clustered
    assert review.open_count(clusters) == 2 and review.next_group(clusters) == 1
    assert rows(review.show_cluster(table, clusters, 1, text="n2")) == [(2, "n2")]
    stay = review.mark_and_stay(table, clusters, [2])
    assert not stay.finished and review.open_count(stay.clusters) == 2
    nxt = review.mark_and_next(table, clusters, [1, 2, 3])
    assert not nxt.finished and review.next_group(nxt.clusters) == 2
    end = review.mark_and_finish(nxt.rows, nxt.clusters, [5])
    assert end.finished and [r[0] for r in rows(end.rows)] == [4, 6, 7]
    rest = review.mark_and_resolve(table, clusters, [1])
    assert [r[0] for r in rows(rest.rows)] == [2, 3, 4, 6, 7]
    all_of_them = review.mark_and_resolve(table, clusters)
    assert [r[0] for r in rows(all_of_them.rows)] == [1, 4, 6, 7]


def test_resolve_keeps_smallest_unmarked(clustered):
    table, clusters = clustered
    marked = review.mark_rows(clusters, [1])
    assert [r[0] for r in rows(review.apply_marks(table, review.resolve_rest(marked)))] == [2, 4, 6, 7]


@pytest.mark.parametrize("limit", [0, 1, 2, 4])
def test_edit_distance_within_a_band(limit):
    rng = random.Random(limit)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(10))) for _ in range(2))
        whole, near = edit_distance(a, b), edit_distance(a, b, limit)
        assert near == whole if whole <= limit else near > limit


def part_sides(spark, sf):
    """Rows that the sweep over prices goes through, and the pairs of near prices among them."""
    from cleanframe.operators.dedup.sweep import Sides, Summary
    from cleanframe.operators.dedup.vectors import groups_of, subsets_of
    part = spark.read.parquet(f"/root/testdata/sf{sf}/part.parquet")
    dims = dimensions(part, "p_name", ["p_brand"], ["p_type", "p_retailprice"])
    tuples = cut_lineage(tuples_of(rank_rows(part, "p_partkey", "p_name", dims), dims))
    found = Sides(cut_lineage(groups_of(subsets_of(tuples, dims), dims)), tuples, dims)
    return found.sources.count() + found.targets.count(), sum(near for _, _, near, _, _ in Summary(tuples, dims).rows())


def test_sweep_grows_with_rows_not_pairs(spark):
    """Ten times the rows of `part` are at most twelve times the rows swept, though many times the pairs."""
    (rows_small, pairs_small), (rows_large, pairs_large) = part_sides(spark, "0.001"), part_sides(spark, "0.01")
    assert rows_large <= 12 * rows_small and pairs_large > 20 * pairs_small


@pytest.mark.parametrize("exact,similar", [([], ["amount"]), (["kind"], ["name", "amount", "born"])])
def test_summary_equals_all_pairs(spark, exact, similar):
    from cleanframe.operators.dedup.detect import pair_summary
    table = people(110, 8) + [(1000, "hot town", "a", "a", 1e17, None), (1001, "hot town", "a", "a", 1e17, None), (1002, "hot town", "a", "a", 3e17, None),
                              (1003, "hot town", "b", "a", 3e17, None), (1004, "hot town", "b", "a", float("inf"), None), (1005, "hot town", "b", "a", float("inf"), None)]
    at = 1 + len(exact) + similar.index("amount")
    want = defaultdict(lambda: [0, 0, 0.0, 0.0])
    for _, _, vector in brute(table, "city", exact, similar):
        level = 0.0 if vector[at] != vector[at] else vector[at]
        sums = want[vector[:at] + vector[at + 1:]]
        want[vector[:at] + vector[at + 1:]] = [sums[0] + 1, sums[1] + (level > 0), sums[2] + level, sums[3] + level**2]
    got = {tuple(r[:-4]): [int(r["pairs"]), int(r["near"]), r["level_sum"], r["level_squares"]]
           for r in pair_summary(spark.createDataFrame(table, SCHEMA), "city", exact, similar).collect()}
    assert set(got) == set(want)
    for vector, sums in want.items():
        assert got[vector][:2] == sums[:2] and np.allclose(got[vector][2:], sums[2:])

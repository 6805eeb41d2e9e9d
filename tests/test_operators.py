"""Values worked out by hand for each operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cleanframe.functions.bins import labels
from cleanframe.operators import dates, encode, impute, numeric, page, predicates, profile, replace, schema
from cleanframe.operators import rows as row_ops
from cleanframe.plans import ordering
from tests.conftest import rows


@pytest.fixture(params=[200_000, 3])
def range_rows(request, monkeypatch):
    """Once with everything in one range, once with many ranges."""
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", request.param)


# --- imputation, replacement ------------------------------------------------------------------------------

def numbers(spark, values, kind="double"):
    return spark.createDataFrame([(i, "1", v) for i, v in enumerate(values, 1)], f"id long, note string, x {kind}")


def column(df, name):
    return [r[0] for r in df.orderBy("id").select(f"`{name}`").collect()]


def test_impute_average(spark):
    assert column(impute.impute(numbers(spark, [2.0, 3.0, 7.0, None]), "x", "AVG"), "x")[-1] == 4
    assert column(impute.impute(numbers(spark, [2, 3, None], "int"), "x", "AVG"), "x")[-1] == 2
    assert column(impute.impute(numbers(spark, [3, 4, None], "int"), "x", "AVG"), "x")[-1] == 4
    assert column(impute.impute(numbers(spark, [None], "double"), "x", "AVG"), "x") == [0.0]


def test_impute_median(spark, range_rows):
    assert column(impute.impute(numbers(spark, [1.0, 1.0, 6.0, 8.0, None]), "x", "MEDIAN"), "x")[-1] == 3.5
    assert column(impute.impute(numbers(spark, [1, 2, None], "int"), "x", "MEDIAN"), "x")[-1] == 2
    assert column(impute.impute(numbers(spark, [None], "int"), "x", "MEDIAN"), "x") == [0]


def test_impute_most_common_and_custom(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "a")], "id long, s string")
    assert column(impute.impute(df, "s", "MCV"), "s")[2] == "a"
    assert column(impute.impute(df, "s", "CUSTOM", "z"), "s")[2] == "z"
    empty = spark.createDataFrame([(1, None)], "id long, s string")
    assert column(impute.impute(empty, "s", "MCV"), "s") == [None]
    with pytest.raises(ValueError):
        impute.impute(df, "s", "AVG")
    with pytest.raises(ValueError):
        impute.impute(df, "s", "GUESS")


@pytest.fixture
def fruit(spark):
    return spark.createDataFrame([(1, "apple"), (2, "lemon")], "id long, word string")


def test_replace(fruit):
    assert column(replace.find_replace(fruit, "word", "substring", "ap", "pine"), "word") == ["pineple", "lemon"]
    assert column(replace.find_replace(fruit, "word", "full replace", "lemon", "grape"), "word") == ["apple", "grape"]
    assert column(replace.find_replace(fruit, "word", "regex", "a.*", "plum"), "word") == ["plum", "lemon"]
    assert column(replace.find_replace(fruit, "word", "substring", "", "x"), "word") == ["apple", "lemon"]
    with pytest.raises(ValueError):
        replace.find_replace(fruit, "word", "soundex", "a", "b")


@pytest.mark.parametrize("text,pattern,put,first,every", [
    ("banana", "an", "X", "bXana", "bXXa"),
    ("banana", "(a)(n)", r"\2\1", "bnaana", "bnanaa"),
    ("a\nb", "a.b", "x", "x", "x"),
    ("cost", "o", "$1", "c$1st", "c$1st"),
    ("cost", "o", "\\\\", "c\\st", "c\\st"),
    ("cost", "o", r"[\&\&]", "c[oo]st", "c[oo]st"),
    ("abab aa", r"(a)\1", "-", "abab -", "abab -"),
    ("Banana", "(?i)b", "x", "xanana", "xanana"),
    ("xyz", "q", "-", "xyz", "xyz"),
    ("aXb", "(?<=a)X", "-", "a-b", "a-b"),
])
def test_regex(spark, text, pattern, put, first, every):
    df = spark.createDataFrame([(1, text)], "id long, s string")
    assert column(replace.find_replace(df, "s", "regex", pattern, put), "s") == [first]
    assert column(replace.find_replace(df, "s", "regex", pattern, put, every=True), "s") == [every]


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "  Mary-Ann (née X) O'Neil_Smith [a] "), (2, None)], "id long, s string")
    assert column(replace.clean_column(df, "s"), "s") == ["mary ann oneil smith", None]


# --- dates ------------------------------------------------------------------------------------------------

def test_date_parts(spark):
    moment = dt.datetime(2018, 3, 4, 5, 6, 7, 120000)  # a Sunday
    df = spark.createDataFrame([(1, moment), (2, dt.datetime(2018, 3, 5)), (3, None)], "id long, ts timestamp_ntz")
    want = {"DOW": [0.0, 1.0, None], "MONTH": [3.0, 3.0, None], "YEAR": [2018.0, 2018.0, None],
            "DATE": ["2018-03-04", "2018-03-05", None], "TIME": ["05:06:07.12", "00:00:00", None]}
    for part, values in want.items():
        once = dates.extract_part(df, "ts", part)
        assert column(once, f"ts ({part})") == values
        assert dates.extract_part(once, "ts", part).columns == once.columns
    with pytest.raises(ValueError):
        dates.extract_part(df, "ts", "WEEK")


# --- numbers ----------------------------------------------------------------------------------------------

def test_normalize(spark):
    got = column(numeric.normalize(numbers(spark, [1.0, 3.0, None]), "x"), "x_norm")
    assert got == [-1.0, 1.0, None]
    assert column(numeric.normalize(numbers(spark, [5, 5], "int"), "x"), "x_norm") == [5.0, 5.0]
    assert column(numeric.normalize(numbers(spark, [None]), "x"), "x_norm") == [None]


def test_equal_width(spark):
    df = numeric.equal_width(numbers(spark, [0.0, 5.0, 5.1, 10.0, None]), "x", 2, index_name="bin")
    assert column(df, "bin") == [1, 1, 2, 2, None]
    assert column(df, "x_intervals_eq_w_2") == ["(-0.01, 5.0]", "(-0.01, 5.0]", "(5.0, 10.0]", "(5.0, 10.0]", None]
    same = numeric.equal_width(numbers(spark, [4.0, 4.0]), "x", 2, index_name="bin")
    assert column(same, "bin") == [1, 1]


def test_equal_frequency_lowered(spark, range_rows):
    df = numeric.equal_frequency(numbers(spark, [10.0, 20.0, 30.0, 40.0, None]), "x", 2, index_name="bin")
    assert column(df, "bin") == [1, 1, None, None, None]
    assert column(df, "x_intervals_eq_f_2")[0] == "(9.99, 29.97]"
    below = numeric.equal_frequency(numbers(spark, [-10.0, 1.0, 2.0, 3.0]), "x", 2, index_name="bin")
    assert column(below, "bin") == [None, 1, None, None]
    with pytest.raises(ValueError, match="increasing"):
        numeric.equal_frequency(numbers(spark, [1.0, 1.0, 1.0, 1.0]), "x", 2)
    with pytest.raises(ValueError, match="at least as many"):
        numeric.equal_frequency(numbers(spark, [1.0, 2.0]), "x", 3)


def test_equal_frequency_quantile(spark, range_rows):
    values = [-10.0, 1.0, 2.0, 2.0, 2.0, 2.0, 9.0, None]
    got = column(numeric.equal_frequency(numbers(spark, values), "x", 3, "quantile", "bin"), "bin")
    assert got == [1, 1, 1, 1, 1, 1, 2, None]
    assert column(numeric.equal_frequency(numbers(spark, [3.0, 3.0]), "x", 2, "quantile", "bin"), "bin") == [1, 1]


def test_manual_bins(spark):
    df = numeric.manual_bins(numbers(spark, [0, 1, 10, 11, 25, None], "int"), "x", "0,10,20")
    assert column(df, "x_intervals_custom") == [None, "(0, 10]", "(0, 10]", "(10, 20]", None, None]
    with pytest.raises(ValueError):
        numeric.discretize(df, "x", "magic")


def test_labels():
    assert labels([0.0, 1 / 3, 2 / 3, 1.0], 3) == ["(0.0, 0.333]", "(0.333, 0.667]", "(0.667, 1.0]"]
    assert labels([1.0001, 1.0002, 1.0003], 3) == ["(1.0001, 1.0002]", "(1.0002, 1.0003]"]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id long, c string")
    got = encode.one_hot(df, "c")
    assert got.columns == ["id", "c", "a", "b"]
    assert rows(got, "id", "a", "b") == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]
    with pytest.raises(ValueError, match="exist already"):
        encode.one_hot(df.withColumn("a", F.lit(1)), "c")
    with pytest.raises(ValueError, match="no values"):
        encode.one_hot(df.where("c IS NULL"), "c")
    with pytest.raises(ValueError, match="text"):
        encode.one_hot(df, "id")
    with pytest.raises(ValueError, match="more than 1"):
        encode.one_hot(df, "c", max_categories=1)


# --- predicates -------------------------------------------------------------------------------------------

@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 5), (4, None, 5), (5, "c", None), (6, "x%y", 2),
                                  (7, "xzy", 2)], "id long, s string, n int")


@pytest.mark.parametrize("tests,removed", [
    ([("", "s", "=", "a")], [1, 2]),
    ([("", "s", "=", "a"), ("OR", "s", "=", "b"), ("AND", "n", "=", "5")], [1, 2, 3]),
    ([("", "s", "=", "b"), ("AND", "n", "=", "5"), ("OR", "n", "<", "2")], [1, 3]),
    ([("", "n", ">=", "2"), ("AND", "s", "<>", "b")], [2, 6, 7]),
    ([("", "s", "CONTAINS", "x%y")], [6, 7]),
    ([("", "n", "CONTAINS", "5")], [2, 3, 4]),
])
def test_remove_where(items, tests, removed):
    left = [r[0] for r in rows(predicates.remove_where(items, tests))]
    assert left == [i for i in range(1, 8) if i not in removed]


def test_predicate_errors(items):
    assert [r[0] for r in rows(predicates.remove_where(items, [("", "s", "CONTAINS", "x%y")], wildcards=False))][-1] == 7
    for tests in ([], [("", "s", "~", "a")], [("", "nope", "=", "a")], [("", "s", "=", "a"), ("XOR", "s", "=", "b")]):
        with pytest.raises(ValueError):
            predicates.remove_where(items, tests)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        predicates.remove_where(items, [("", "n", "=", "many")]).collect()


def test_outliers_and_search(items):
    assert [r[0] for r in rows(predicates.remove_outliers(items, "n", 2, less_than=True))] == [2, 3, 4, 5, 6, 7]
    assert [r[0] for r in rows(predicates.remove_outliers(items, "n", 2))] == [1, 5, 6, 7]
    assert [r[0] for r in rows(predicates.search(items, "5"))] == [2, 3, 4]
    assert predicates.search(items, "").count() == 7
    assert [r[0] for r in rows(predicates.nulls_of(items, "n"))] == [5]
    assert predicates.non_nulls_of(items, "n").count() == 6


# --- pages ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shallow", [0, 100_000])
def test_page(items, monkeypatch, shallow, range_rows):
    monkeypatch.setattr(page, "SHALLOW_ROWS", shallow)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(page.page(items, 1, 3)) == [2, 3, 4]
    assert ids(page.page(items, 0, None, "n")) == [1, 6, 7, 2, 3, 4, 5]
    assert ids(page.page(items, 0, 4, "n", ascending=False)) == [5, 4, 3, 2]
    assert ids(page.page(items, 5, None, "n")) == [4, 5]
    assert ids(page.page(items, 5, None, "n", ascending=False)) == [6, 1]
    shown, total, matching = page.grid(items, 0, 2, "s", True, "x")
    assert (ids(shown), total, matching) == ([6, 7], 7, 2)


# --- profile ----------------------------------------------------------------------------------------------

def test_profile(spark):
    df = spark.createDataFrame([(1, 1, "b"), (2, None, "a"), (3, 3, None), (4, 3, "a")], "id long, n int, s string")
    assert rows(profile.table_profile(df)) == [
        ("n", "integer", pytest.approx(7 / 3), 1.0, 3.0, "3", 1), ("s", "text", None, None, None, "a", 1)]
    empty = df.where("id > 9")
    assert rows(profile.table_profile(empty))[0] == ("n", "integer", 0.0, 0.0, 0.0, None, 0)
    assert rows(profile.column_profile(empty, "n", zero_if_empty=False))[0][2] is None
    assert profile.median(df, "n") == 3.0 and profile.median(empty, "n") is None
    assert rows(profile.most_common(df, "s")) == [("a", 2)]


def test_histogram(spark):
    df = numbers(spark, [0.0, 1.0, 1.5, 10.0, None])
    got = profile.histogram(df, "x").collect()
    assert [r["n"] for r in got] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert got[0]["label"] == "(-0.01, 1.0]" and got[9]["label"] == "(9.0, 10.0]"
    assert profile.histogram(df.where("id > 9"), "x").count() == 0
    assert rows(profile.value_counts(df.withColumn("k", F.col("id") % 2), "k")) == [(0, 2), (1, 3)]


# --- schema, rows -----------------------------------------------------------------------------------------

def test_casts(spark):
    text = spark.createDataFrame([(1, "12"), (2, None)], "id long, `my-column` string")
    assert schema.schema_report(schema.change_type(text, "my-column", "INT")).collect()[1]["type"] == "integer"
    bad = spark.createDataFrame([(1, "2.5")], "id long, s string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schema.change_type(bad, "s", "INT").collect()
    halves = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, -0.5), (4, None)], "id long, x double")
    assert column(schema.change_type(halves, "x", "INT"), "x") == [2, 4, 0, None]
    days = spark.createDataFrame([(1, "03/04/2018"), (2, "2018-03-04 05:06:07"), (3, None), (4, "12/31/2018 01:02:03")],
                                 "id long, s string")
    assert column(schema.change_type(days, "s", "TIMESTAMP"), "s") == [
        dt.datetime(2018, 3, 4), dt.datetime(2018, 3, 4, 5, 6, 7), None, dt.datetime(2018, 12, 31, 1, 2, 3)]
    with pytest.raises(Exception, match="not a timestamp"):
        schema.change_type(bad.withColumn("s", F.lit("soon")), "s", "TIMESTAMP").collect()
    long_text = spark.createDataFrame([(1, "x" * 300)], "id long, s string")
    assert len(column(schema.change_type(long_text, "s", "VARCHAR(255)"), "s")[0]) == 255
    with pytest.raises(ValueError):
        schema.change_type(days, "s", "JSON")
    with pytest.raises(ValueError):
        schema.change_type(halves, "x", "TIMESTAMP")


def test_columns(fruit):
    assert schema.add_column(fruit, "x", "INT").columns == ["id", "word", "x"]
    assert schema.add_column(fruit, "word", "INT") is fruit
    assert schema.drop_column(fruit, "word").columns == ["id"]
    assert schema.rename_column(fruit, "word", 'new"-test').columns == ["id", "new-test"]
    for new in ("", "  ", "word", "id"):
        with pytest.raises(ValueError):
            schema.rename_column(fruit, "word", new)
    assert schema.id_first(fruit.select("word", "id")).columns == ["id", "word"]


def test_ids(spark, range_rows):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("hgfedcbaaa")] + [(None, 99)], "s string, n int")
    got = row_ops.assign_id(df, ["s", "n"])
    assert got.columns == ["id", "s", "n"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1, "a", 7), (2, "a", 8), (3, "a", 9), (4, "b", 6), (5, "c", 5), (6, "d", 4), (7, "e", 3), (8, "f", 2),
        (9, "g", 1), (10, "h", 0), (11, None, 99)]


def test_insert_and_delete(fruit, spark):
    more = row_ops.insert_rows(fruit, [{"word": "pear"}, {"word": ""}, {}])
    assert rows(more) == [(1, "apple"), (2, "lemon"), (3, "pear"), (4, None), (5, None)]
    with pytest.raises(ValueError):
        row_ops.insert_rows(fruit, [{"nope": 1}])
    assert rows(row_ops.delete_ids(more, [1, 3])) == [(2, "lemon"), (4, None), (5, None)]
    assert rows(row_ops.delete_ids(more, list(range(3, 2000)))) == rows(fruit)
    assert rows(row_ops.keep_ids(more, spark.createDataFrame([(2,), (2,)], "x long"))) == [(2, "lemon")]
    assert row_ops.max_id(more) == 5 and row_ops.min_id(more) == 1
    tail = spark.createDataFrame([("z", "kiwi"), ("a", "mango")], "k string, word string")
    assert rows(row_ops.append_rows(fruit, tail, ["k"]))[2:] == [(3, "mango"), (4, "kiwi")]


def test_ids_with_none(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert rows(row_ops.delete_ids(df, [1, None])) == [(2,), (3,), (4,), (5,)]
    assert rows(row_ops.delete_ids(df, [1, None, *range(10, 2000)])) == [(2,), (3,), (4,), (5,)]
    assert rows(row_ops.delete_ids(df, [])) == [(i,) for i in range(1, 6)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (9.0,)], "x double")
    assert [r["n"] for r in profile.histogram(df, "x").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert profile.mean_and_std(df, "x")[0] == 4.0
    assert numeric.fit_equal_frequency(df, "x", 3, "quantile") == [1.0, 2.0, 9.0]
    binned = numeric.equal_width(df, "x", 2, index_name="b")
    assert [r["b"] for r in binned.collect()] == [1, 1, None, 2]
    assert [r["x_norm"] is None for r in numeric.normalize(df, "x").collect()] == [False, False, True, False]

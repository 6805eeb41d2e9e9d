import datetime as dt

from pyspark.sql import functions as F

from cleanframe.operators import dates, impute, numeric, predicates, replace
from cleanframe.plans.storage import new_folder
from cleanframe.streaming import activity, cleaning
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, 12)


def events(spark):
    data = [(i, T0 + dt.timedelta(seconds=40 * i), i % 4, "ab"[i % 2], float(i) if i % 5 else None) for i in range(60)]
    return spark.createDataFrame(data, "id long, ts timestamp_ntz, user_id long, kind string, value double")


def test_active_users(spark):
    df = events(spark)
    at = T0 + dt.timedelta(seconds=40 * 59)
    assert rows(activity.active_users(df, at, "kind")) == [("a", 2), ("b", 2)]
    assert rows(activity.active_users(df, at, "kind", me=0)) == [("a", 1), ("b", 2)]
    assert rows(activity.active_users(df, at, "kind", timeout=0)) == [("b", 1)]
    assert rows(activity.active_user_list(df, at, timeout=40)) == [(2,), (3,)]
    assert activity.active_user_list(df, T0 - dt.timedelta(days=1)).isEmpty()


def test_clean_stream_equals_clean_table(spark):
    df = events(spark)
    folder = new_folder(spark, "in")
    df.repartition(4).write.parquet(folder)
    mean = impute.fit(df, "value", "AVG")
    edges = numeric.fit_equal_width(df, "value", 4)
    steps = [lambda d: predicates.remove_outliers(d, "value", 50), lambda d: impute.fill(d, "value", mean),
             lambda d: numeric.apply_bins(d, "value", edges, "label"), lambda d: dates.extract_part(d, "ts", "TIME"),
             lambda d: replace.find_replace(d, "kind", "regex", "a", "A"), lambda d: predicates.search(d, "A")]
    stream = cleaning.read_stream(spark, folder, df.schema, files_per_batch=1)
    assert rows(cleaning.run_available(cleaning.apply_steps(stream, steps))) == rows(cleaning.apply_steps(df, steps))


def test_rolling_users(spark):
    df = events(spark)
    folder = new_folder(spark, "in")
    df.coalesce(1).write.parquet(folder)
    table = {r[:2]: r[2] for r in rows(activity.rolling_active_users(df, "kind"))}
    stream = activity.rolling_active_users(cleaning.read_stream(spark, folder, df.schema), "kind")
    closed = {r[:2]: r[2] for r in rows(cleaning.run_available(stream))}
    assert closed and closed.items() <= table.items()
    end = T0 + dt.timedelta(seconds=40 * 59) - dt.timedelta(minutes=10)
    assert set(closed) == {k for k in table if k[1] + dt.timedelta(minutes=5) <= end}


def test_restart_writes_rows_once(spark):
    df = events(spark)
    source, out = new_folder(spark, "in"), new_folder(spark, "out")
    df.where("id < 30").write.parquet(source)
    assert cleaning.run_available(cleaning.read_stream(spark, source, df.schema), out).count() == 30
    df.where("id >= 30").write.mode("append").parquet(source)
    result = cleaning.run_available(cleaning.read_stream(spark, source, df.schema), out)
    assert result.select(F.count_distinct("id"), F.count("*")).first() == (60, 60)


def test_row_wise_operators_on_a_stream(spark):
    from cleanframe.operators import encode, rows as row_ops, schema
    from cleanframe.operators.joins import Pair, join_tables
    df = events(spark)
    folder = new_folder(spark, "in")
    df.write.parquet(folder)
    kinds = spark.createDataFrame([("a", "first"), ("b", "second")], "kind string, label string")
    gone = spark.createDataFrame([(3,), (5,)], "id long")
    operators = [
        lambda d: schema.change_type(d, "value", "INT"), lambda d: schema.change_type(d, "id", "VARCHAR(255)"),
        lambda d: schema.rename_column(schema.add_column(d, "x", "BIT"), "kind", "sort of"), lambda d: schema.drop_column(d, "ts"),
        lambda d: row_ops.delete_ids(d, [1, 2]), lambda d: row_ops.delete_ids(d, gone), lambda d: row_ops.keep_ids(d, gone),
        lambda d: row_ops.conform(d.select("id", "kind"), df), lambda d: predicates.nulls_of(d, "value"),
        lambda d: predicates.remove_where(d, [("", "kind", "CONTAINS", "a"), ("OR", "value", ">", "30")]),
        lambda d: numeric.apply_normalize(d, "value", 2.0, 3.0), lambda d: numeric.manual_bins(d, "value", "0,10,20"),
        lambda d: encode.apply_one_hot(d, "kind", ["a", "b"]), lambda d: replace.clean_column(d, "kind"),
        lambda d: replace.find_replace(d, "user_id", "full replace", "1", "9"),
        lambda d: join_tables({"e": d, "k": kinds}, [Pair("e", "kind", "=", "k", "kind")], id_col=None),
    ]
    stream = cleaning.read_stream(spark, folder, df.schema)
    for operator in operators:
        assert rows(cleaning.run_available(operator(stream))) == rows(operator(df))

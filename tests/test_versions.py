import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cleanframe.operators import changes, history
from cleanframe.operators.versions import VersionStore
from cleanframe.plans.storage import new_folder
from tests.conftest import rows

T0 = dt.datetime(2020, 1, 1)


@pytest.fixture
def before(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, None, 2.0), (3, "c", None), (4, "d", 4.0)], "id long, `s x` string, n double")


def test_diff_and_undo(spark, before):
    after = spark.createDataFrame([(1, "a", 1.5), (2, "new", 2.0), (3, "c", 0.1), (9, None, 9.0)], before.schema)
    found = changes.diff(before, after)
    assert rows(found.changes.where("change = 'update'")) == [(2, "update", "s x", None, "new"), (3, "update", "n", None, "0.1")]
    assert {r["id"] for r in found.changes.where("change = 'delete'").collect()} == {4}
    assert {r["id"] for r in found.changes.where("change = 'insert'").collect()} == {9}
    assert rows(changes.undo(after, found)) == rows(before)
    assert changes.undo(after, found).schema.simpleString() == before.schema.simpleString()
    assert changes.diff(before, before).changes.isEmpty()


def test_undo_of_schema_changes(before):
    for after in (before.drop("n"), before.withColumn("extra", F.lit(1)), before.where("id > 2").drop("s x")):
        assert rows(changes.undo(after, changes.diff(before, after))) == rows(before)


CELLS = st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", ""])), st.one_of(st.none(), st.floats(allow_nan=False)))
TABLES = st.dictionaries(st.integers(1, 12), CELLS, max_size=8)


@settings(max_examples=5, deadline=None)
@given(TABLES, TABLES)
def test_undo_takes_any_change_back(spark, old, new):
    schema = "id long, s string, n double"
    before, after = [spark.createDataFrame([(k, *v) for k, v in t.items()], schema) for t in (old, new)]
    assert rows(changes.undo(after, changes.diff(before, after))) == rows(before)


def test_snapshots(spark, before):
    store = VersionStore(spark, new_folder(spark, "t"), limit=2)
    store.write_raw(before.withColumnRenamed("n", "ts (DOW)"), T0)
    first = store.snapshot(before.where("id = 1"), "one row", T0)
    with pytest.raises(ValueError, match="exists already"):
        store.snapshot(before, "", T0)
    second = store.snapshot(before.where("id < 3"), "two rows", T0 + dt.timedelta(seconds=1))
    with pytest.raises(ValueError, match="2 snapshots"):
        store.snapshot(before, "", T0 + dt.timedelta(seconds=2))
    assert first == "backup_20200101000000" and store.note(second) == "two rows"
    assert [r["name"] for r in store.snapshots().collect()] == [first, second]
    assert store.restore(second).count() == 2 and store.raw().count() == 4
    assert store.taken_at(first) == T0
    store.delete(first)
    assert [r["name"] for r in store.snapshots().collect()] == [second]
    with pytest.raises(ValueError, match="no such snapshot"):
        store.restore(first)
    third = store.snapshot(before, "again", T0 + dt.timedelta(seconds=3))
    assert store.restore(third).count() == 4
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_raw(before)


def test_history(spark):
    log = history.empty_log(spark)
    for i in range(5):
        log = history.log_action(log, "t", f"step {i}", T0 + dt.timedelta(minutes=i), limit=3)
    log = history.log_action(log, "u", "other", T0, limit=3).cache()
    assert rows(log.where("NOT undone"), "action_id") == [(3,), (4,), (5,), (6,)]
    listed = history.actions(log, "t", "step", 0, 2, "date", False).collect()
    assert [(r["action_id"], r["is_undoable"]) for r in listed] == [(5, True), (4, False)]
    undone = history.mark_undone(log, 5)
    assert [r["is_undoable"] for r in history.actions(undone, "t").collect()] == [False, False, False, True, False]
    with pytest.raises(ValueError):
        history.mark_undone(undone, 5)
    with pytest.raises(ValueError):
        history.mark_undone(log, 1)
    assert rows(history.keep_until(log, "t", T0 + dt.timedelta(minutes=1)), "action_id") == [(1,), (2,), (6,)]
    assert rows(history.keep_first(log, "t"), "action_id") == [(1,), (6,)]


def test_lasting_log(spark):
    log = history.ActionLog(spark, new_folder(spark, "log"), limit=2)
    assert log.read().count() == 0
    assert [log.add("t", f"step {i}", T0) for i in range(3)] == [1, 2, 3]
    assert rows(log.read(), "action_id", "undone") == [(1, True), (2, False), (3, False)]
    log.undo(3)
    assert rows(log.read(), "action_id", "undone") == [(1, False), (2, False), (3, True)]
    with pytest.raises(ValueError):
        log.undo(3)
    with pytest.raises(ValueError):
        history.ActionLog(spark, "x", limit=-1)
    assert history.close_old_actions(log.read(), 0).where("undone").count() == 1


def test_unknown_and_deleted_snapshots(spark, before):
    store = VersionStore(spark, new_folder(spark, "t"))
    store.write_raw(before, T0)
    name = store.snapshot(before, "", T0)
    path = store._path(store._version_of(name))
    store.delete(name)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    for read in (store.note, store.taken_at):
        with pytest.raises(ValueError, match="no such snapshot"):
            read("x")

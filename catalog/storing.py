"""Files in and out, versions, history, streams."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from catalog.registry import query, table
from cleanframe.operators import changes, dates, history, impute, page, predicates, replace, rows, versions
from cleanframe.plans.storage import new_folder
from cleanframe.sources import csv as csv_files
from cleanframe.sources import dump, load, zipped
from cleanframe.streaming import activity, cleaning


@query("csv_roundtrip", "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_roundtrip(spark, d):
    folder = new_folder(spark, "csv")
    csv_files.write_csv(table(spark, d, "orders"), folder, ";", "'", "NA", "o_orderkey")
    raw = spark.read.option("header", True).option("sep", ";").option("quote", "'").option("escape", "'").csv(folder)
    return csv_files.finish(raw, True, [], None)


@query("csv_text", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
        CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def csv_text(spark, d):
    folder = new_folder(spark, "csv")
    csv_files.write_csv(table(spark, d, "customer"), folder)
    return csv_files.read_csv(spark, folder).drop("id")


@query("csv_append", """
    SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS name, s_acctbal AS balance FROM supplier
    UNION ALL SELECT (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name, c_acctbal
    FROM customer""")
def csv_append(spark, d):
    """Customers, written in key order as one sorted export, appended to the suppliers."""
    first = rows.assign_id(table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"),
                                                         F.col("s_acctbal").alias("balance")), ["s_suppkey"]).drop("s_suppkey")
    folder = new_folder(spark, "csv")
    more = table(spark, d, "customer").orderBy("c_custkey").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    csv_files.write_csv(more, folder)
    return csv_files.append_csv(first, folder)


@query("dump_load", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
    FROM customer""")
def dump_load(spark, d):
    folder = new_folder(spark, "dump")
    quoted = [F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) for c in ("c_name", "c_mktsegment")]
    values = F.concat(F.lit("("), F.concat_ws(", ", F.col("c_custkey").cast("string"), quoted[0],
                                              F.col("c_acctbal").cast("string"), quoted[1]), F.lit(")"))
    statement = F.concat(F.lit("DELETE FROM customer;\nINSERT INTO customer (c_custkey, c_name, c_acctbal, c_mktsegment) VALUES "),
                         values, F.lit(";"))
    table(spark, d, "customer").select(statement.alias("value")).write.text(folder)
    return dump.read_dump(spark, folder)["customer"].drop("id")


@query("dump_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN text <> '' THEN text END AS text, lang FROM documents")
def dump_documents(spark, d):
    """All texts, with their quotes, line ends, brackets and semicolons."""
    folder = new_folder(spark, "dump")
    docs = table(spark, d, "documents")
    text = F.concat(F.lit("'"), F.replace(F.concat(F.col("text")), F.lit("'"), F.lit("''")), F.lit("'"))
    statement = F.concat(F.lit("INSERT INTO docs (doc_id, text, lang) VALUES ("), F.concat_ws(
        ", ", F.col("doc_id").cast("string"), text, F.concat(F.lit("'"), F.col("lang"), F.lit("'"))), F.lit(");"))
    docs.select(statement.alias("value")).write.text(folder)
    return dump.read_dump(spark, folder)["docs"].drop("id")


@query("csv_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_documents(spark, d):
    """All texts, with line ends inside quotes."""
    folder = new_folder(spark, "csv")
    csv_files.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), folder)
    return csv_files.read_csv(spark, folder).drop("id")


@query("load_append", """
    SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS name FROM supplier
    UNION ALL SELECT (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name FROM customer""")
def load_append(spark, d):
    first = rows.assign_id(table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), ["s_suppkey"]).drop("s_suppkey")
    folder = new_folder(spark, "load") + ".csv"
    csv_files.write_csv(table(spark, d, "customer").orderBy("c_custkey").select(F.col("c_name").alias("name")), folder)
    return load.load(spark, folder, "people", existing={"people": first})["people"]


def _zip_writer(folder, member_name=None):
    """Write each task's rows as one archive with one CSV member; yield its path."""
    def write(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        base = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
        if base.startswith("file:/") and not base.startswith("file://"):
            base = "file://" + base[len("file:"):]
        system, path = fs.FileSystem.from_uri(base)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/part-{task}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open(member_name or f"nested/{task}/events.csv", "w") as member:
                text = io.TextIOWrapper(member, "utf-8", newline="")
                writer = csv.writer(text)
                header = False
                for batch in batches:
                    if not header:
                        writer.writerow(batch.columns)
                        header = True
                    writer.writerows(batch.itertuples(index=False))
                text.flush()
        yield pd.DataFrame({"path": [f"{path}/part-{task}.zip"]})
    return write


@query("zip_load", "SELECT event_id, user_id, event_type, props FROM events")
def zip_load(spark, d):
    folder = new_folder(spark, "zip")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "props").repartition(3)
    events.mapInPandas(_zip_writer(folder), "path string").count()
    return zipped.read_zip(spark, folder, typed=True)["events"].drop("id")


@query("zip_same_member", "SELECT event_id, user_id FROM events")
def zip_same_member(spark, d):
    """Archives that all hold a member of the same name."""
    folder = new_folder(spark, "zip")
    events = table(spark, d, "events").select("event_id", "user_id").repartition(12)
    events.mapInPandas(_zip_writer(folder, "events.csv"), "path string").count()
    return zipped.read_zip(spark, folder, typed=True)["events"].drop("id")


@query("copy_table", "SELECT * FROM part")
def copy_table(spark, d):
    return rows.copy_table(table(spark, d, "part"), new_folder(spark, "copy"))


@query("load_by_extension", "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_by_extension(spark, d):
    folder = new_folder(spark, "load") + ".csv"
    csv_files.write_csv(table(spark, d, "customer"), folder, id_col="c_custkey")
    return load.load(spark, folder, "customer", typed=True)["customer"].drop("id").withColumn(
        "c_nationkey", F.col("c_nationkey").cast("int"))


# --- versions ---------------------------------------------------------------------------------------------

def _before_and_after(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    after = predicates.remove_outliers(before, "o_totalprice", 400000)
    after = replace.find_replace(after, "o_orderpriority", "full replace", "5-LOW", "5-LATER")
    extra = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_totalprice", F.lit(None).cast("string").alias("o_orderpriority"))
    return before, after.unionByName(extra)


@query("diff_versions", """
    SELECT o_orderkey AS id, 'delete' AS change, c AS "column", v AS old, NULL AS new FROM (
        SELECT o_orderkey, unnest(['o_orderkey', 'o_totalprice', 'o_orderpriority']) AS c,
            unnest([CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), o_orderpriority]) AS v
        FROM orders WHERE o_totalprice > 400000)
    UNION ALL SELECT o_orderkey, 'update', 'o_orderpriority', '5-LOW', '5-LATER' FROM orders
        WHERE o_totalprice <= 400000 AND o_orderpriority = '5-LOW'
    UNION ALL SELECT -o_orderkey - 1, 'insert', c, NULL, v FROM (
        SELECT o_orderkey, unnest(['o_orderkey', 'o_totalprice', 'o_orderpriority']) AS c,
            unnest([CAST(-o_orderkey - 1 AS VARCHAR), CAST(o_totalprice AS VARCHAR), NULL]) AS v
        FROM orders WHERE o_orderstatus = 'F')""")
def diff_versions(spark, d):
    return changes.diff(*_before_and_after(spark, d), "o_orderkey").changes


@query("undo", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def undo(spark, d):
    before, after = _before_and_after(spark, d)
    return changes.undo(after, changes.diff(before, after, "o_orderkey"))


@query("undo_logged", """
    SELECT o_orderkey, o_totalprice, o_orderpriority, 2 AS actions, 1 AS undone, 'Removed outliers' AS still_open FROM orders
    WHERE NOT o_totalprice > 400000""")
def undo_logged(spark, d):
    """Two logged changes of the orders, the second one undone: the rows as after the first, and what the log says."""
    log = history.ActionLog(spark, new_folder(spark, "log"))
    raw = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    first = predicates.remove_outliers(raw, "o_totalprice", 400000)
    log.add("orders", "Removed outliers")
    second = replace.find_replace(first, "o_orderpriority", "full replace", "5-LOW", "5-LATER").where("o_orderkey % 5 <> 0")
    action = log.add("orders", "Replaced 5-LOW and removed rows")
    back = changes.undo(second, changes.diff(first, second, "o_orderkey"))
    log.undo(action)
    said = log.read().agg(F.count("*").cast("int").alias("actions"), F.count_if("undone").cast("int").alias("undone"),
                          F.max(F.when(~F.col("undone"), F.col("action_desc"))).alias("still_open")).first()
    return back.select("*", *[F.lit(said[c]).alias(c) for c in ("actions", "undone", "still_open")])


@query("snapshot_restore", "SELECT * FROM orders WHERE NOT o_totalprice > 200000")
def snapshot_restore(spark, d):
    store = versions.VersionStore(spark, new_folder(spark, "versions"))
    current = store.write_raw(table(spark, d, "orders"))
    smaller = predicates.remove_outliers(current, "o_totalprice", 200000)
    name = store.snapshot(smaller, "without large orders")
    return store.restore(name)


@query("raw_page", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 40 OFFSET 60")
def raw_page(spark, d):
    store = versions.VersionStore(spark, new_folder(spark, "versions"))
    raw = store.write_raw(table(spark, d, "orders"))
    return page.page(raw, 60, 40, "o_totalprice", True, "o_orderkey")


@query("snapshot_list", """
    SELECT name, version, note, "at", n FROM (VALUES ('backup_20200102030406', 2::BIGINT, 'second', TIMESTAMP '2020-01-02 03:04:06'),
        ('backup_20200102030407', 3::BIGINT, 'third', TIMESTAMP '2020-01-02 03:04:07')) AS t(name, version, note, "at")
    JOIN (SELECT 2 AS version, count(*) AS n FROM supplier WHERE s_suppkey >= 20
          UNION ALL SELECT 3, count(*) FROM supplier WHERE s_suppkey >= 30) USING (version)""")
def snapshot_list(spark, d):
    """Three snapshots of the suppliers with ever fewer rows, the first one deleted, and the rows of each."""
    store = versions.VersionStore(spark, new_folder(spark, "versions"))
    current = store.write_raw(table(spark, d, "supplier"))
    names = [store.snapshot(current.where(F.col("s_suppkey") >= 10 * (i + 1)), note, dt.datetime(2020, 1, 2, 3, 4, 5 + i))
             for i, note in enumerate(("first", "second", "third"))]
    store.delete(names[0])
    counts = [store.restore(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in names[1:]]
    return store.snapshots().join(counts[0].unionByName(counts[1]), "name")


@query("revert_to_raw", "SELECT * FROM nation")
def revert_to_raw(spark, d):
    store = versions.VersionStore(spark, new_folder(spark, "versions"))
    store.write_raw(table(spark, d, "nation"))
    return store.raw()


def _log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("action_id"), F.col("event_type").alias("table"), F.col("ts").alias("date"),
        F.concat(F.lit("Changed by "), F.col("user_id").cast("string")).alias("action_desc"),
        (F.col("event_id") % 3 == 0).alias("undone"))


LOG_SQL = """(SELECT event_id AS action_id, event_type AS "table", ts AS date, 'Changed by ' || CAST(user_id AS VARCHAR)
    AS action_desc, event_id % 3 = 0 AS undone FROM events)"""


@query("history_limit", f"""
    SELECT action_id, "table", date, action_desc, undone OR row_number() OVER (
        PARTITION BY "table", undone ORDER BY action_id DESC) > 20 AS undone FROM {LOG_SQL}""")
def history_limit(spark, d):
    return history.close_old_actions(_log(spark, d))


@query("history_list", f"""
    SELECT date, action_desc, action_id, undone, action_id = (
        SELECT max(action_id) FROM {LOG_SQL} WHERE "table" = 'view' AND NOT undone) AS is_undoable
    FROM {LOG_SQL} WHERE "table" = 'view' AND action_desc LIKE '%1%' ORDER BY date DESC, action_id DESC LIMIT 30""")
def history_list(spark, d):
    return history.actions(_log(spark, d), "view", "1", 0, 30, "date", False)


@query("log_actions", """
    WITH l AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS action_id, r_name AS action_desc, count(*) OVER () AS n FROM region)
    SELECT action_id, 'region' AS "table", action_desc, action_id = n OR action_id < n - 3 AS undone FROM l""")
def log_actions(spark, d):
    """An action per region in a lasting log of at most three open actions, the last one undone."""
    log = history.ActionLog(spark, new_folder(spark, "log"), limit=3)
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():
        last = log.add("region", r["r_name"])
    log.undo(last)
    return log.read().select("action_id", "table", "action_desc", "undone")


@query("history_after_restore", f"""
    SELECT * FROM {LOG_SQL} WHERE "table" <> 'click' OR date <= TIMESTAMP '2024-01-15'""")
def history_after_restore(spark, d):
    return history.keep_until(_log(spark, d), "click", dt.datetime(2024, 1, 15))


@query("history_after_revert", f"""
    SELECT * FROM {LOG_SQL} WHERE "table" <> 'click' OR action_id = (SELECT min(action_id) FROM {LOG_SQL} WHERE "table" = 'click')""")
def history_after_revert(spark, d):
    return history.keep_first(_log(spark, d), "click")


# --- streams ----------------------------------------------------------------------------------------------

@query("stream_clean", """
    SELECT event_id, CAST(dayofweek(ts) AS DOUBLE) AS "ts (DOW)", replace(event_type, 'c', 'C') AS event_type,
        coalesce(CASE WHEN event_id % 5 <> 0 THEN value END,
            (SELECT avg(CASE WHEN event_id % 5 <> 0 THEN value END) FROM events)) > 0 AS positive
    FROM events WHERE NOT coalesce(CASE WHEN event_id % 5 <> 0 THEN value END > 90, false)""")
def stream_clean(spark, d):
    """A table of events cleaned as a stream; the average comes from a pass over the table."""
    def holes(df):
        return df.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))

    events = table(spark, d, "events")
    average = impute.fit(holes(events), "value", "AVG")
    stream = cleaning.read_stream(spark, f"{d}/events.parque[t]", events.schema)
    cleaned = cleaning.apply_steps(stream, [
        holes, lambda df: predicates.remove_outliers(df, "value", 90), lambda df: impute.fill(df, "value", average),
        lambda df: replace.find_replace(df, "event_type", "substring", "c", "C"), lambda df: dates.extract_part(df, "ts", "DOW")])
    shown = cleaned.select("event_id", "ts (DOW)", "event_type", (F.col("value") > 0).alias("positive"))
    return cleaning.run_available(shown)


@query("stream_rolling_users", """
    SELECT * FROM (SELECT event_type, date_trunc('minute', ts) - INTERVAL (i) MINUTE AS window_start,
        count(DISTINCT user_id) AS n_users FROM events, generate_series(0, 4) AS g(i) GROUP BY ALL)
    WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_rolling_users(spark, d):
    """The windows that the stream's watermark has closed."""
    events = table(spark, d, "events")
    stream = cleaning.read_stream(spark, f"{d}/events.parque[t]", events.schema)
    return cleaning.run_available(activity.rolling_active_users(stream, "event_type"))

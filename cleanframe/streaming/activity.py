"""Active users of an event table, as of a time or over rolling windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.columns import data_type, ref, require

# Fixed value: seconds after which a silent user counts as gone.
TIMEOUT_SECONDS = 300


def _recent(events: DataFrame, at: dt.datetime | Column, time_col: str, user_col: str, me, timeout: int) -> DataFrame:
    require(events, time_col, user_col)
    now = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(at, dt.datetime) else at
    since = now - F.expr(f"INTERVAL {int(timeout)} SECONDS")
    recent = events.where((ref(time_col) >= since) & (ref(time_col) <= now))
    return recent if me is None else recent.where(ref(user_col) != F.lit(me))


def active_users(events: DataFrame, at: dt.datetime | Column, group_col: str, user_col: str = "user_id",
                 time_col: str = "ts", me=None, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """(group, n_users): distinct users other than `me` seen in the `timeout` seconds up to `at`."""
    recent = _recent(events, at, time_col, user_col, me, timeout)
    return recent.groupBy(ref(group_col)).agg(F.count_distinct(ref(user_col)).alias("n_users"))


def active_user_list(events: DataFrame, at: dt.datetime | Column, user_col: str = "user_id", time_col: str = "ts",
                     me=None, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    return _recent(events, at, time_col, user_col, me, timeout).select(ref(user_col)).distinct()


def rolling_active_users(events: DataFrame, group_col: str, user_col: str = "user_id", time_col: str = "ts",
                         watermark: str = "10 minutes", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(group, window_start, n_users) per sliding window.

    On a stream each user is let through once per group and window, then users are counted. A window is shown when it is
    closed: when a row `watermark` later than its end has come. Rows later than the watermark are dropped. On a table all
    windows are shown.
    """
    users = ref(user_col)
    dtype = data_type(events, time_col)
    if events.isStreaming:
        # A watermark needs the zoned type; the window start is turned back into the type of the column.
        events = events.withColumn(time_col, ref(time_col).cast("timestamp")).withWatermark(time_col, watermark)
        placed = events.where(users.isNotNull()).select(
            ref(group_col), users, F.window(ref(time_col), length, slide).alias("_window"))
        counted = placed.dropDuplicates([group_col, user_col, "_window"]).groupBy(ref(group_col), "_window").agg(
            F.count("*").alias("n_users"))
    else:
        counted = events.groupBy(ref(group_col), F.window(ref(time_col), length, slide).alias("_window")).agg(
            F.count_distinct(users).alias("n_users"))
    return counted.select(ref(group_col), F.col("_window.start").cast(dtype).alias("window_start"), "n_users")

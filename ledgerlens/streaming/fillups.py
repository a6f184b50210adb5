"""Streaming forms of the daily fill-up pattern and of rapid succession; an extension, as the analysis itself is batch.

State is kept per user and day, or session, until the watermark passes; then the row
comes out once, and later rows for it are dropped. Different times are counted exactly, from
a set in the state, so events that are read twice under one time count once as fill-ups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How late an event may be before its day or session is closed.
LATE = "2 days"


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _instants(events: DataFrame, user: str, time: str, late: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Events that have a user and a time, with a watermark, and what turns an instant back into the table's kind of time.

    Watermarks need instants; times without a zone are taken as they stand, in UTC, whatever the session's zone.
    """
    x, back = events.where(F.col(time).isNotNull() & F.col(user).isNotNull()), lambda c: c
    if dict(events.dtypes)[time] == "timestamp_ntz":
        x = x.withColumn(time, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{time}`)")))
        back = lambda c: F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_EPOCH))
    return x.withWatermark(time, late), back


def daily(events: DataFrame, user: str = "user_id", time: str = "ts", amount: str = "value", kind: str | None = None, late: str = LATE) -> DataFrame:
    """(user, day, fillups, events, total, average, span_hours, rapid) of each closed day, with kinds if there is a column for them.

    fillups are different times; rapid are days of three or more of them within less than an hour from first to last; kinds
    are the different values of ``kind``, ascending.
    """
    x, back = _instants(events, user, time, late)
    also = [] if kind is None else [F.array_join(F.sort_array(F.collect_set(kind)), ", ").alias("kinds")]
    span = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / 3_600_000_000
    g = x.groupBy(F.window(time, "1 day"), user).agg(F.size(F.collect_set(time)).alias("fillups"), F.count(F.lit(1)).alias("events"), F.sum(amount).alias("total"), F.avg(amount).alias("average"), span.alias("span_hours"), *also)
    rapid = (F.col("fillups") >= 3) & (F.col("span_hours") < 1)
    return g.select(user, back(F.col("window.start")).alias("day"), "fillups", "events", "total", "average", "span_hours", rapid.alias("rapid"), *([] if kind is None else ["kinds"]))


def rapid(events: DataFrame, user: str = "user_id", time: str = "ts", amount: str = "value", gap: str = "1 hour", least: int = 3, late: str = LATE) -> DataFrame:
    """(user, start, end, fillups, total): closed sessions of a user with ``least`` different times or more, no two in a row further apart than ``gap``.

    end is ``gap`` after the session's last event.
    """
    x, back = _instants(events, user, time, late)
    g = x.groupBy(F.session_window(time, gap), user).agg(F.size(F.collect_set(time)).alias("fillups"), F.sum(amount).alias("total"))
    return g.where(F.col("fillups") >= least).select(user, back(F.col("session_window.start")).alias("start"), back(F.col("session_window.end")).alias("end"), "fillups", "total")


def caught_up(events: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Everything the operator has given so far, after it has read all that is there of a stream.

    Rows go to a table below ``path``, offsets and state beside it, so a second call with the same path goes on where
    the first one, or a lost driver, stopped.
    """
    out = operator(events)
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return events.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")

"""Queries over the event stream, each read to its end, against the batch form of days and sessions that are closed by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming import fillups
from .base import Query


def events(spark, d) -> DataFrame:
    # a pattern, as a stream can't begin at a path that is one file
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")


def _days(s, d):
    x = fillups.caught_up(events(s, d), lambda e: fillups.daily(e, kind="event_type"), shared_path(s, "stream-days"))
    return x.withColumn("day", F.to_date("day"))


def _sessions(s, d):
    return fillups.caught_up(events(s, d), fillups.rapid, shared_path(s, "stream-sessions")).withColumnsRenamed({"start": "session_start", "end": "session_end"})


QUERIES = {
    "stream_days": Query("user_id day fillups events total:4 average:4 span_hours:6 rapid kinds", _days,
        """select *, fillups >= 3 and span_hours < 1 as rapid from (
             select user_id, cast(ts as date) as day, cast(count(distinct ts) as integer) as fillups, count(*) as events, sum(value) as total, avg(value) as average,
                    (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0e0 as span_hours, array_to_string(list_sort(list(distinct event_type)), ', ') as kinds
             from events where user_id is not null and ts is not null group by 1, 2)
           where day + interval 1 day <= (select max(ts) - interval 2 days from events)""", base=False),
    "stream_rapid": Query("user_id session_start session_end fillups total:4", _sessions,
        """select user_id, min(ts) as session_start, max(ts) + interval 1 hour as session_end, cast(count(distinct ts) as integer) as fillups, sum(value) as total from (
             select *, sum(cast(coalesce(ts - before > interval 1 hour, true) as integer)) over (partition by user_id order by ts) as session from (
               select *, lag(ts) over (partition by user_id order by ts) as before from events where user_id is not null and ts is not null))
           group by user_id, session having count(distinct ts) >= 3 and max(ts) + interval 1 hour <= (select max(ts) - interval 2 days from events)""", base=False),
}

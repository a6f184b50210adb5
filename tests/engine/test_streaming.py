"""Streams that are stopped, go on, bring late and repeated events, and end with rows that no longer change."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans.streams import QUERIES
from ledgerlens.streaming import fillups

DAY = datetime(2024, 1, 1)


def put(spark, folder, name, rows, kind="timestamp_ntz"):
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast(kind)).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, kind="timestamp_ntz"):
    return spark.readStream.schema(f"user_id long, ts {kind}, event_type string, value double").parquet(f"{folder}/*")


def at(day, minute=0):
    return DAY + timedelta(days=day, minutes=minute)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_days_go_on_after_a_stop_and_drop_what_is_late(spark, tmp_path, kind):
    put(spark, tmp_path / "in", "a", [(1, at(0, 10 * i), "view", 5.0) for i in range(4)] + [(1, at(0, 10), "click", 1.0), (None, at(0), "view", 1.0), (2, None, "view", 1.0), (2, at(4), "view", 2.0)], kind)
    days = lambda e: fillups.daily(e, kind="event_type")
    one = fillups.caught_up(stream(spark, tmp_path / "in", kind), days, f"file://{tmp_path}/out").collect()
    assert [(r.user_id, r.fillups, r.events, r.total, r.rapid, r.kinds) for r in one] == [(1, 4, 5, 21.0, True, "click, view")]
    assert one[0].span_hours == 0.5 and str(one[0].day) == "2024-01-01 00:00:00"
    # the first day is closed: its late events change nothing; the fifth day isn't, and the seventh closes it
    put(spark, tmp_path / "in", "b", [(1, at(0, 5), "late", 9.0), (2, at(4, 300), "view", 3.0), (2, at(4), "view", 2.0), (3, at(7, 60), "view", 1.0)], kind)
    two = fillups.caught_up(stream(spark, tmp_path / "in", kind), days, f"file://{tmp_path}/out").orderBy("day").collect()
    assert [(r.user_id, r.fillups, r.events, r.total) for r in two] == [(1, 4, 5, 21.0), (2, 2, 3, 7.0)]
    again = fillups.caught_up(stream(spark, tmp_path / "in", kind), days, f"file://{tmp_path}/out")
    assert again.count() == 2


def test_sessions_need_different_times(spark, tmp_path):
    rows = [(1, at(0, 20 * i), "view", 5.0) for i in range(3)] + [(2, at(0, 0), "view", 1.0)] * 3 + [(3, at(0, 61 * i), "view", 1.0) for i in range(3)] + [(1, at(9), "view", 1.0)]
    put(spark, tmp_path / "in", "a", rows)
    got = fillups.caught_up(stream(spark, tmp_path / "in"), fillups.rapid, f"file://{tmp_path}/out").collect()
    assert [(r.user_id, r.start, r.end, r.fillups, r.total) for r in got] == [(1, at(0), at(0, 100), 3, 15.0)]


def test_queries_read_one_file_and_an_empty_one(spark, tmp_path):
    spark.createDataFrame([], "user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [QUERIES[q](spark, f"file://{tmp_path}").count() for q in ("stream_days", "stream_rapid")] == [0, 0]
    assert QUERIES["stream_days"](spark, "/root/testdata/sf0.001").count() > 0

"""Transactions as a table bucketed by vehicle and day, from which copies, fill-ups and telemetry need no shuffle.

The table is written once, with the one shuffle that ``features.prepared`` makes each time otherwise; what reads it
later finds a vehicle's day in one bucket, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import clean, features

#: Files that vehicle-days are dealt to; a file is a task of every later read.
BUCKETS = 64


def write(df: DataFrame, name: str, path: str, config: Config = Config(), buckets: int = BUCKETS) -> None:
    """Canonical or user-named transactions under a table name, below a path that all machines share.

    Texts in place of times or numbers are cast first, as the day must be known to deal by it; cells that don't fit are null.
    """
    x = features.dealt(clean.types(clean.plain(df, config)))
    keys = features.DEALT
    x.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows, dealt; ``features.prepared`` takes them as they are."""
    return spark.table(name)

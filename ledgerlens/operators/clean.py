"""Cleaning: names, blanks, copies, types, the unfinished last month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, ConfigError
from ..schema import REQUIRED, STRINGS, TYPES, missing, nan_to_null

ABSOLUTE = ("odometer_miles", "fuel_volume_gallons", "distance_miles")


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The user's names (values) become canonical ones (keys)."""
    return df.withColumnsRenamed({user: name for name, user in columns.items() if user in df.columns})


def require(df: DataFrame) -> DataFrame:
    """Raises ConfigError with the sorted list of missing columns; else the required columns alone."""
    if lacking := missing(df):
        raise ConfigError(f"missing columns: {', '.join(lacking)}")
    return df.select(*REQUIRED)


def blank_to_null(df: DataFrame) -> DataFrame:
    texts = [c for c, k in df.dtypes if k == "string"]
    return df.withColumns({c: F.when(~F.col(c).rlike(r"^\s*$"), F.col(c)) for c in texts}) if texts else df


def types(df: DataFrame) -> DataFrame:
    """Each canonical column in its type; a cell that doesn't fit becomes null."""
    have = dict(df.dtypes)
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in TYPES.items() if c in have and have[c] != k})


def introduced_nulls(before: DataFrame) -> DataFrame:
    """(column_name, introduced): cells of each column that ``types`` turns into nulls."""
    have = dict(before.dtypes)
    cast = [c for c, k in TYPES.items() if c in have and have[c] != k]
    if not cast:
        return before.sparkSession.createDataFrame([], "column_name string, introduced long")
    counts = before.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(TYPES[c]).isNull()).alias(c) for c in cast])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("introduced")) for c in cast])).alias("x")).select("x.*")


def drop_unfinished_month(df: DataFrame, days: int = 5) -> DataFrame:
    """Without the last month, if its last transaction lies more than ``days`` whole days before its end; null times stay.

    The latest time is one row, so the join broadcasts it; nothing is shuffled.
    """
    last = df.agg(F.max("transaction_timestamp").alias("_last"))
    left = F.datediff(F.last_day("_last"), F.to_date("_last"))
    bad = last.select(F.when(left > days, F.date_format("_last", "yyyy-MM")).alias("_bad"))
    month = F.date_format("transaction_timestamp", "yyyy-MM")
    return df.join(F.broadcast(bad), F.lit(True), "left").where(F.col("_bad").isNull() | ~F.coalesce(month == F.col("_bad"), F.lit(False))).drop("_bad")


def absolute(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.abs(c) for c in ABSOLUTE})


def plain(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Canonical names, the required columns, blanks and NaN as nulls: the rows that are compared for copies."""
    return blank_to_null(nan_to_null(require(rename(df, config.columns))))


def clean(df: DataFrame, config: Config = Config()) -> DataFrame:
    """All steps in order; copies go by a shuffle of whole rows."""
    return absolute(drop_unfinished_month(types(plain(df, config).dropDuplicates()), config.data_requirements.monthend_days))


def counts(df: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: initial, duplicates, incomplete, final; one shuffle of whole rows, then counts by month."""
    x = types(plain(df, config).groupBy(*REQUIRED).agg(F.count(F.lit(1)).alias("_n")))
    month = F.date_format("transaction_timestamp", "yyyy-MM")
    m = x.groupBy(month.alias("_m")).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_d"), F.max("transaction_timestamp").alias("_t"))
    last = F.max(F.col("_t"))
    one = m.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("initial"), F.coalesce(F.sum("_d"), F.lit(0)).alias("_different"), F.max_by("_d", "_t").alias("_latest"), (F.datediff(F.last_day(last), F.to_date(last)) > config.data_requirements.monthend_days).alias("_bad"))
    gone = F.when(F.col("_bad"), F.col("_latest")).otherwise(0)
    return one.select("initial", (F.col("initial") - F.col("_different")).alias("duplicates"), gone.alias("incomplete"), (F.col("_different") - gone).alias("final"))

"""Periods, target and peers, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config


def status(y0: Column, y1: Column, months: Column, current_months: Column, config: Config = Config()) -> Column:
    """single, split or insufficient, from the first and last year and the months of all years and of the last."""
    need = config.data_requirements
    return F.when((y0 == y1) | (months <= need.min_months), "single").when(current_months > need.min_current_year_months, "split").otherwise("insufficient")


def period(df: DataFrame, config: Config = Config()) -> DataFrame:
    """One row (y0, y1, months, current_months, status). Months are grouped first, so the rest runs on a few rows."""
    m = df.where("transaction_timestamp is not null").groupBy(F.year("transaction_timestamp").alias("y"), F.month("transaction_timestamp").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    years = m.groupBy("y").agg(F.count(F.lit(1)).alias("k"))
    x = years.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.coalesce(F.sum("k"), F.lit(0)).alias("months"), F.max_by("k", "y").alias("current_months"))
    return x.withColumn("status", status(*map(F.col, ("y0", "y1", "months", "current_months")), config))


def in_period(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds the boolean in_period: the current calendar year if the data are split, else everything. The decision is one broadcast row."""
    p = period(df, config).select("y1", "status")
    x = df.join(F.broadcast(p), F.lit(True))
    return x.withColumn("in_period", F.coalesce((F.col("status") != "split") | (F.year("transaction_timestamp") == F.col("y1")), F.lit(False))).drop("y1", "status")


def slices(df: DataFrame) -> dict[str, DataFrame]:
    """The five analysis slices as lazy filters of one frame with is_target and in_period."""
    return {"complete": df, "target_period": df.where("is_target and in_period"), "peer_period": df.where("not is_target and in_period"), "target_historical": df.where("is_target"), "peer_historical": df.where("not is_target")}


def slice_counts(df: DataFrame) -> DataFrame:
    """(slice, row_count) of all five in one pass."""
    t, p = F.col("is_target"), F.col("in_period")
    named = {"complete": F.lit(True), "target_period": t & p, "peer_period": ~t & p, "target_historical": t, "peer_historical": ~t}
    one = df.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(n).alias("row_count")) for n in named])).alias("x")).select("x.*")


def label(df: DataFrame) -> DataFrame:
    """One row: the analysis period, as '2025 YTD (Jan-Jun)' within a year, else '(Nov 2024-Feb 2025)'."""
    x = df.agg(F.min("transaction_timestamp").alias("a"), F.max("transaction_timestamp").alias("b"))
    same = F.concat(F.year("b").cast("string"), F.lit(" YTD ("), F.date_format("a", "MMM"), F.lit("-"), F.date_format("b", "MMM"), F.lit(")"))
    other = F.concat(F.lit("("), F.date_format("a", "MMM yyyy"), F.lit("-"), F.date_format("b", "MMM yyyy"), F.lit(")"))
    return x.select(F.when(F.year("a") == F.year("b"), same).otherwise(other).alias("period"))


def scope(df: DataFrame) -> DataFrame:
    """One row: peers' distinct locations, first and last time, rows."""
    return df.agg(F.countDistinct(F.when(~F.col("is_target"), F.col("location_index"))).alias("peer_locations"), F.min("transaction_timestamp").alias("first_time"), F.max("transaction_timestamp").alias("last_time"), F.count(F.lit(1)).alias("row_count"))

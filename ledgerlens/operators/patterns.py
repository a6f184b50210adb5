"""Suspicious fill-ups and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import RedFlags
from ..functions import ranges


def _every():
    """The whole frame: for entity frames of a few rows, not transactions."""
    return W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def shared_days(df: DataFrame) -> DataFrame:
    """Transactions on driver-days with two or more rows: a semi-join written as a count over the day, so one shuffle and no join."""
    day = W.partitionBy("driver_name", "date_only")
    x = df.where("driver_name is not null and date_only is not null")
    return x.withColumn("_n", F.count(F.lit(1)).over(day)).where("_n >= 2").drop("_n")


def day_patterns(df: DataFrame) -> DataFrame:
    """One row for each driver-day with two or more transactions; the rule is a filter on the group, so rows go out already reduced.

    non_diesel_rate takes rows of diesel against different times and so may be below 0.
    """
    t = F.col("datetime_parsed")
    g = df.where("driver_name is not null and date_only is not null").groupBy("driver_name", "date_only").agg(
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct("datetime_parsed").alias("fillup_count"),
        F.array_join(F.array_sort(F.collect_set("product_clean")), ", ").alias("products"),
        F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("total_cost"),
        F.avg("transaction_amount").alias("avg_cost"),
        F.avg("fuel_volume_gallons").alias("avg_volume"),
        F.countDistinct("merchant_name").alias("unique_stations"),
        ((F.unix_seconds(F.max(t).cast("timestamp")) - F.unix_seconds(F.min(t).cast("timestamp"))) / 3600.0).alias("time_span_hours"),
        F.bool_and("has_eld_activity").alias("has_eld_match"),
        F.count_if("is_diesel_def").alias("diesel_count"),
    )
    return g.where("_n >= 2").drop("_n").withColumn("non_diesel_rate", 1 - F.try_divide("diesel_count", "fillup_count"))


def red_flags(p: DataFrame, flags: RedFlags = RedFlags()) -> DataFrame:
    """Adds red_flags, fraud_indicators, misuse_indicators, suspicion_score; the two low quartiles are one broadcast row."""
    q = ranges.quantiles(p, {"_qc": F.col("avg_cost"), "_qv": F.col("avg_volume")}, (flags.low_quantile,)).select(F.get("_qc", F.lit(0)).alias("_qc"), F.get("_qv", F.lit(0)).alias("_qv"))
    x = p.join(F.broadcast(q), F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False))
    tests = {
        "LC": (no(F.col("avg_cost") <= F.col("_qc")), 1, 0),
        "LV": (no(F.col("avg_volume") <= F.col("_qv")), 1, 0),
        "ND": (no(F.col("non_diesel_rate") >= flags.non_diesel_rate), 2, 0),
        "MF": (F.col("fillup_count") >= flags.many_fillups, 0, 1),
        "MS": (F.col("unique_stations") > 1, 0, 1),
        "NE": (~F.col("has_eld_match"), 0, 1),
        "RS": ((F.col("fillup_count") >= flags.rapid_fillups) & no(F.col("time_span_hours") < flags.rapid_hours), 0, 1),
    }
    x = x.withColumn("red_flags", F.concat_ws(" ", *[F.when(c, F.lit(k)) for k, (c, _, _) in tests.items()]))
    for name, at in (("fraud_indicators", 1), ("misuse_indicators", 2)):
        x = x.withColumn(name, sum((F.when(t[0], t[at]).otherwise(0) for t in tests.values() if t[at]), F.lit(0)))
    return x.withColumn("suspicion_score", F.col("fraud_indicators") * flags.passenger_weight + F.col("misuse_indicators") * flags.misuse_weight).drop("_qc", "_qv")


def summary(p: DataFrame) -> DataFrame:
    """One row over flagged driver-days."""
    return p.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("driver_name").alias("drivers"), F.avg("fillup_count").alias("mean_fillups"), F.count_if(F.col("suspicion_score") >= 4).alias("high_risk"), F.count_if(F.col("fraud_indicators") >= 2).alias("likely_fraud"), F.avg("suspicion_score").alias("mean_score"))


def stations(df: DataFrame) -> DataFrame:
    """The profile of each station."""
    g = df.where("merchant_name is not null").groupBy("merchant_name").agg(
        F.count("datetime_parsed").alias("transaction_count"),
        F.countDistinct("driver_name").alias("unique_drivers"),
        F.countDistinct("vehicle_id").alias("unique_vehicles"),
        F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("total_cost"),
        F.avg("transaction_amount").alias("avg_cost"),
        F.avg((~F.col("has_eld_activity")).cast("double")).alias("no_eld_rate"),
        F.avg((~F.col("is_diesel_def")).cast("double")).alias("non_diesel_rate"),
        F.avg("fuel_volume_gallons").alias("avg_volume"),
    )
    return g.withColumn("pct_of_total", F.try_divide("transaction_count", F.sum("transaction_count").over(_every())))


def suspicious_stations(df: DataFrame, flags: RedFlags = RedFlags(), n: int = 10) -> DataFrame:
    s = stations(df)
    q = s.agg(F.percentile("non_diesel_rate", F.lit(flags.station_high_quantile)).alias("_a"), F.percentile("no_eld_rate", F.lit(flags.station_high_quantile)).alias("_b"), F.percentile("avg_cost", F.lit(flags.low_quantile)).alias("_c"))
    x = s.join(F.broadcast(q), F.lit(True)).withColumns({"high_non_diesel": F.col("non_diesel_rate") >= F.col("_a"), "high_no_eld": F.col("no_eld_rate") >= F.col("_b"), "low_avg_cost": F.col("avg_cost") <= F.col("_c")})
    x = x.withColumn("suspicion_flags", 2 * F.col("high_non_diesel").cast("int") + F.col("high_no_eld").cast("int") + F.coalesce(F.col("low_avg_cost"), F.lit(False)).cast("int"))
    return x.where((F.col("suspicion_flags") > 0) & (F.col("transaction_count") >= flags.station_min_count)).drop("_a", "_b", "_c").orderBy(F.desc("suspicion_flags"), "merchant_name").limit(n)

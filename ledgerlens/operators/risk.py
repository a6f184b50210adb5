"""Entity metrics, volumes, breakdowns and the composite risk profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config
from ..functions import ranks, stats

RATES = {"no_eld": "has_eld_activity", "non_diesel": "is_diesel_def", "after_hours": "is_business_hours"}


def _every():
    """The whole frame: for entity frames of a few rows, not transactions."""
    return W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def metrics(df: DataFrame, entity: str = "driver_name") -> DataFrame:
    """Transactions, counts of the three flags being false and total cost of each entity; one shuffle of partial sums."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("datetime_parsed").alias("total_transactions"), *[F.count_if(~F.col(flag)).alias(f"{name}_count") for name, flag in RATES.items()], F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("total_cost"))


def rates(m: DataFrame) -> DataFrame:
    n = F.col("total_transactions")
    return m.withColumns({f"{name}_rate": F.try_divide(f"{name}_count", n) for name in RATES} | {"avg_cost_per_transaction": F.try_divide("total_cost", n)})


def profile(df: DataFrame, entity: str = "driver_name", config: Config = Config()) -> DataFrame:
    """The composite risk profile of each entity with enough transactions; the first step alone touches the transactions."""
    x = rates(metrics(df, entity).where(F.col("total_transactions") >= config.data_requirements.min_risk_transactions))
    for name in RATES:
        low, high = stats.wilson_sql(f"{name}_count", "total_transactions", config.statistics.alpha)
        x = x.withColumns({f"{name}_ci_lower": F.expr(low), f"{name}_ci_upper": F.expr(high)})
        x = ranks.percentile_rank(x, f"{name}_rate", f"{name}_percentile")
    x = ranks.percentile_rank(x, "avg_cost_per_transaction", "cost_percentile")
    x = x.withColumn("cost_deviation_score", F.abs(F.col("cost_percentile") - 50) * 2)
    w = config.risk_weights
    score = F.col("no_eld_percentile") * w.no_eld + F.col("non_diesel_percentile") * w.non_diesel + F.col("after_hours_percentile") * w.after_hours + F.col("cost_deviation_score") * w.cost
    t = config.thresholds
    return x.withColumns({"composite_risk_score": score, "no_eld_risk_flag": F.col("no_eld_ci_lower") > t.high_no_eld, "non_diesel_risk_flag": F.col("non_diesel_ci_lower") > t.high_non_diesel, "after_hours_risk_flag": F.col("after_hours_ci_lower") > t.high_after_hours}).withColumn("risk_band", F.expr(stats.risk_band_sql("composite_risk_score", t.bands)))


def top(df: DataFrame, column: str, name: str, n: int = 10) -> DataFrame:
    """The n rows of the largest column, ties by name; no full sort."""
    return df.orderBy(F.desc(column), name).limit(n)


def vehicles(df: DataFrame, config: Config = Config()) -> DataFrame:
    """The profile of vehicles with each one's most frequent driver (ties: the first by name)."""
    pairs = df.where("vehicle_id is not null and driver_name is not null").groupBy("vehicle_id", "driver_name").agg(F.count(F.lit(1)).alias("n"))
    main = pairs.groupBy("vehicle_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "driver_name"))["driver_name"].alias("primary_driver"))
    return profile(df, "vehicle_id", config).join(main, "vehicle_id", "left")


def volumes(df: DataFrame, least: int = 10) -> DataFrame:
    """Volume and cost of each driver with ``least`` transactions, and the z-score of its volume among them."""
    x = df.where("driver_name is not null").groupBy("driver_name").agg(F.count("datetime_parsed").alias("transactions"), F.sum("fuel_volume_gallons").alias("total_volume"), F.avg("fuel_volume_gallons").alias("avg_volume"), F.sum("transaction_amount").alias("total_cost")).where(F.col("transactions") >= least)
    return x.withColumn("volume_z", F.try_divide(F.col("total_volume") - F.avg("total_volume").over(_every()), F.stddev_samp("total_volume").over(_every())))


def fleet_volume(df: DataFrame) -> DataFrame:
    """One row: drivers, mean and deviation of their volumes; the deviation is null below two."""
    x = df.where("driver_name is not null").groupBy("driver_name").agg(F.sum("fuel_volume_gallons").alias("v"))
    return x.agg(F.count("v").alias("drivers"), F.avg("v").alias("mean_volume"), F.stddev_samp("v").alias("std_volume"))


def products(df: DataFrame, by: str | None = "driver_name") -> DataFrame:
    """Count, share and cost of each product, for each value of ``by``."""
    keys = [by] if by else []
    x = df.where(F.col(by).isNotNull()) if by else df
    x = x.groupBy(*keys, "product_clean").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("cost"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def multi_days(df: DataFrame) -> DataFrame:
    """Days with several fill-ups of each driver: how many, the most fill-ups, the mean amount on them; zeros if none."""
    many: Column = F.col("fillups_per_day") > 1
    return df.where("driver_name is not null").groupBy("driver_name").agg(
        F.countDistinct(F.when(many, F.col("date_only"))).alias("multi_days"), F.coalesce(F.max(F.when(many, F.col("fillups_per_day"))), F.lit(0)).alias("max_fillups"), F.coalesce(F.avg(F.when(many, F.col("transaction_amount"))), F.lit(0.0)).alias("multi_day_amount")
    )


def deep_dive(df: DataFrame, config: Config = Config(), names: list[str] | None = None) -> DataFrame:
    """The focused drivers, named or the highest scores: profile, distinct vehicles, multi-fill-up days and main product."""
    focus = profile(df, "driver_name", config)
    focus = focus.where(F.col("driver_name").isin(*names)) if names else top(focus, "composite_risk_score", "driver_name", config.output.auto_analyze)
    cars = df.where("driver_name is not null").groupBy("driver_name").agg(F.countDistinct("vehicle_id").alias("vehicles"))
    main = products(df).groupBy("driver_name").agg(F.min(F.struct((-F.col("n")).alias("k"), "product_clean", "share")).alias("m")).select("driver_name", F.col("m.product_clean").alias("main_product"), F.col("m.share").alias("main_share"))
    out = focus
    for side in (cars, multi_days(df), main):
        out = out.join(side, "driver_name", "left")
    return out

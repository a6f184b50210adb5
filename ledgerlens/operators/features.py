"""Feature columns and telemetry normalisation; expressions and one partitioning by vehicle and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import BusinessHours, Config, Target
from ..schema import TYPES
from . import clean, split


def dates(df: DataFrame, days: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Calendar parts; ``year`` and ``week_number`` are ISO; a null time counts as weekend."""
    t = F.col("transaction_timestamp")
    x = df.withColumns({"datetime_parsed": t, "date_only": F.col("_day") if "_day" in df.columns else F.to_date(t), "year": F.expr("extract(yearofweek from transaction_timestamp)").cast("int"), "month": F.date_format(t, "yyyy-MM"), "week_number": F.weekofyear(t), "weekday": F.weekday(t), "day_of_month": F.dayofmonth(t)})
    return x.withColumn("is_weekend", ~F.coalesce(F.col("weekday").isin(*days), F.lit(False)))


def clock(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour": F.hour("transaction_timestamp"), "minute": F.minute("transaction_timestamp")})


def business_hours(df: DataFrame, hours: BusinessHours = BusinessHours()) -> DataFrame:
    after, before = F.col("hour") >= hours.start_hour, F.col("hour") < hours.end_hour
    inside = (after & before) if hours.start_hour < hours.end_hour else (after | before)
    return df.withColumn("is_business_hours", F.coalesce(inside, F.lit(False)) & ~F.col("is_weekend"))


def rush_hours(df: DataFrame) -> DataFrame:
    x = df.withColumns({"is_morning_rush": F.coalesce(F.col("hour").isin(7, 8), F.lit(False)), "is_evening_rush": F.coalesce(F.col("hour").isin(16, 17, 18), F.lit(False))})
    return x.withColumn("is_rush_hour", F.col("is_morning_rush") | F.col("is_evening_rush"))


def day_part(df: DataFrame) -> DataFrame:
    h = F.col("hour")
    return df.withColumn("time_of_day_category", F.when(h.isNull(), "Unknown").when(h < 6, "Early Morning").when(h < 12, "Morning").when(h < 18, "Afternoon").otherwise("Evening"))


def product(df: DataFrame) -> DataFrame:
    x = df.withColumn("product_clean", F.lower(F.regexp_replace(F.coalesce("product_category", F.lit("unknown")), r"^\s+|\s+$", "")))
    return x.withColumn("is_diesel_def", F.col("product_clean").isin("diesel", "def"))


def cost_per_gallon(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_per_gallon", F.try_divide("transaction_amount", "fuel_volume_gallons"))


def size(df: DataFrame) -> DataFrame:
    a = F.col("transaction_amount")
    return df.withColumn("transaction_size_category", F.when(a.isNull(), "Unknown").when(a < 50, "Small").when(a <= 150, "Medium").otherwise("Large"))


def _spread(day: str = "date_only") -> Column:
    """0, but for rows with neither vehicle nor day, which may be many: those are dealt to groups by their odometer and amount."""
    lost = F.col("vehicle_index").isNull() & F.col(day).isNull()
    return F.when(lost, F.pmod(F.xxhash64("odometer_miles", "transaction_amount", "driver_index"), F.lit(1024)).cast("int")).otherwise(0)


def _vehicle_days(df: DataFrame):
    """df with ``_spread`` and the window of a vehicle-day."""
    return (df if "_spread" in df.columns else df.withColumn("_spread", _spread())), W.partitionBy("vehicle_index", "date_only", "_spread")


def fillups_per_day(df: DataFrame) -> DataFrame:
    """Different times of each vehicle-day, on each of its rows; null without vehicle or day.

    The count of changes in time order gives it in the partitioning that the telemetry
    steps need too, without a set for each row.
    """
    x, day = _vehicle_days(df)
    t = F.col("transaction_timestamp")
    before = F.lag(t).over(day.orderBy("transaction_timestamp", "odometer_miles", "transaction_amount"))
    x = x.withColumn("_new", F.when(t.isNotNull() & (before.isNull() | (before != t)), 1).otherwise(0))
    known = F.col("vehicle_index").isNotNull() & F.col("date_only").isNotNull()
    x = x.withColumn("fillups_per_day", F.when(known, F.sum("_new").over(day))).drop("_new")
    return x if "_spread" in df.columns else x.drop("_spread")


def branch(df: DataFrame, target: Target = Target()) -> DataFrame:
    mine = F.coalesce(F.col("location_index") == target.location, F.lit(False))
    return df.withColumns({"branch_group": F.when(mine, target.name).otherwise("Other Branches"), "is_target": mine})


def mileage(df: DataFrame) -> DataFrame:
    return df.withColumn("mpg", F.try_divide("distance_miles", "fuel_volume_gallons"))


def _share(part: str, whole: str) -> Column:
    x = F.try_divide(part, whole) * 100
    return F.when(x.isNotNull(), F.least(x, F.lit(100.0)))


def engine_shares(df: DataFrame) -> DataFrame:
    return df.withColumns({"idle_percentage": _share("idle_duration_minutes", "engine_runtime_minutes"), "driving_percentage": _share("driving_duration_minutes", "engine_runtime_minutes")})


def inverted(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, ~F.col(source))


def above(df: DataFrame, source: str, threshold: float, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(source) > threshold, F.lit(False)))


def telemetry_mode(df: DataFrame) -> DataFrame:
    """One row (days, mode): 'granular' if a vehicle-day has more than one distance, else 'daily'."""
    day = df.where("vehicle_index is not null and date_only is not null").groupBy("vehicle_index", "date_only").agg((F.min("distance_miles") < F.max("distance_miles")).alias("many"))
    return day.agg(F.count(F.lit(1)).alias("days"), F.when(F.coalesce(F.bool_or("many"), F.lit(False)), "granular").otherwise("daily").alias("mode"))


def telemetry(df: DataFrame, mode: str | None = None) -> DataFrame:
    """has_eld_activity and is_first_transaction_of_day; in daily mode distance stays on the day's first row only.

    The mode is found in the data, unless given or there as the column ``_mode``, and comes in as one broadcast row. Equal
    times are ordered by odometer and amount. Rows of a vehicle without a day, or of a day without a vehicle, are a group
    with a first row too; rows with neither are up to 1,024 groups.
    """
    x, day = _vehicle_days(df)
    first = day.orderBy(F.asc_nulls_last("transaction_timestamp"), "odometer_miles", "transaction_amount")
    x = x.withColumns({"has_eld_activity": F.col("distance_miles").isNotNull(), "is_first_transaction_of_day": F.row_number().over(first) == 1})
    if mode is not None:
        x = x.withColumn("_mode", F.lit(mode))
    elif "_mode" not in df.columns:
        x = x.join(F.broadcast(telemetry_mode(df).select("mode")), F.lit(True)).withColumnRenamed("mode", "_mode")
    x = x.withColumn("distance_miles", F.when((F.col("_mode") == "granular") | F.col("is_first_transaction_of_day"), F.col("distance_miles"))).drop("_mode")
    return x if "_spread" in df.columns else x.drop("_spread")


def features(df: DataFrame, config: Config = Config(), mode: str | None = None) -> DataFrame:
    """All feature columns of cleaned transactions."""
    x = business_hours(clock(dates(df, config.business_hours.business_days)), config.business_hours)
    x = branch(fillups_per_day(size(cost_per_gallon(product(day_part(rush_hours(x)))))), config.target)
    return telemetry(engine_shares(mileage(x)), mode)


def facts(x: DataFrame, config: Config = Config()) -> DataFrame:
    """One row (_bad, _mode, _year) of typed transactions: the unfinished last month, if any, the telemetry mode of the others, and the year that the analysis is about, if the data are split.

    Vehicle-days are grouped, then months, so all come from one pass; copies change none of them.
    """
    t = F.col("transaction_timestamp")
    day = x.groupBy("vehicle_index", F.to_date(t).alias("_d")).agg((F.min(F.abs("distance_miles")) < F.max(F.abs("distance_miles"))).alias("many"), F.max(t).alias("last"))
    many = F.col("vehicle_index").isNotNull() & F.col("_d").isNotNull() & F.col("many")
    month = day.groupBy(F.date_format("_d", "yyyy-MM").alias("month"), F.year("_d").alias("year")).agg(F.coalesce(F.bool_or(many), F.lit(False)).alias("many"), F.max("last").alias("last"))
    end = month.agg(F.max("last").alias("last"), F.collect_list(F.struct("month", "many", "year")).alias("months"))  # a few hundred months
    bad = F.when(F.datediff(F.last_day("last"), F.to_date("last")) > config.data_requirements.monthend_days, F.date_format("last", "yyyy-MM"))
    end = end.withColumn("_bad", bad)
    end = end.withColumn("months", F.filter("months", lambda m: F.col("_bad").isNull() | F.coalesce(m["month"] != F.col("_bad"), F.lit(True))))
    end = end.withColumn("_years", F.filter(F.transform("months", lambda m: m["year"]), lambda y: y.isNotNull()))
    granular, y0, y1 = F.exists("months", lambda m: m["many"]), F.array_min("_years"), F.array_max("_years")
    status = split.status(y0, y1, F.size("_years"), F.size(F.filter("_years", lambda y: y == y1)), config)
    return end.select("_bad", F.when(F.coalesce(granular, F.lit(False)), "granular").otherwise("daily").alias("_mode"), F.when(status == "split", y1).alias("_year"))


#: The columns that rows are dealt by: copies share them, as do the rows of a vehicle's day.
DEALT = ("vehicle_index", "_day", "_spread")


def dealt(x: DataFrame) -> DataFrame:
    """Typed rows with _day and _spread, to be partitioned by ``DEALT``."""
    return x.withColumn("_day", F.to_date("transaction_timestamp")).withColumn("_spread", _spread("_day"))


class Steps:
    """Counts of ``prepared``'s rows that come with the first job over them, without a pass of their own."""

    def __init__(self):
        self._seen = {k: Observation() for k in ("initial", "different", "final")}

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """initial, duplicates, incomplete and final, as ``clean.counts`` has them; waits for a job over the whole frame."""
        n = {k: o.get["n"] for k, o in self._seen.items()}
        return {"initial": n["initial"], "duplicates": n["initial"] - n["different"], "incomplete": n["different"] - n["final"], "final": n["final"]}


def prepared(df: DataFrame, config: Config = Config(), steps: Steps | None = None, current: bool = False) -> DataFrame:
    """``features`` of ``clean``ed transactions, in two scans and one shuffle of whole rows.

    Copies share vehicle and day, so rows are dealt by those, compared and given their day's features where they are. With
    ``steps`` the job over the frame counts the rows of each step on its way. With ``current`` only rows of the analysis
    period (``split.in_period``) are returned. A table of ``sources.bucketed`` needs no such shuffle. Months are kept or left
    out whole, so what no one asks for is left out before rows are dealt, unless steps are counted or times are texts.
    """
    watch = steps.watch if steps else lambda _, x: x
    bucketed = set(DEALT) <= set(df.columns)
    raw = df.drop("_day", "_spread") if bucketed else clean.plain(df, config)
    typed = dict(raw.dtypes)
    scalars = facts(clean.types(raw), config)
    month = F.date_format("transaction_timestamp", "yyyy-MM")
    kept = F.col("_bad").isNull() | ~F.coalesce(month == F.col("_bad"), F.lit(False))
    if current:
        kept &= F.coalesce(F.col("_year").isNull() | (F.year("transaction_timestamp") == F.col("_year")), F.lit(False))
    if all(typed.get(c) == TYPES[c] for c in ("vehicle_index", "transaction_timestamp")):
        x = watch("initial", df if bucketed else dealt(raw))
        if steps is None:
            few = F.broadcast(scalars.select("_bad", "_year", (F.col("_mode") == "granular").alias("_granular")))
            x = x.join(few, F.lit(True)).where(kept).drop("_bad", "_year")
        x = clean.types((x if bucketed else x.repartition(*DEALT)).dropDuplicates())
    else:  # texts are compared as they are, before they have a day
        x = clean.types(watch("initial", raw).dropDuplicates())
    if "_granular" in x.columns:
        x = x.withColumn("_mode", F.when(F.col("_granular"), "granular").otherwise("daily")).drop("_granular")
    else:
        x = watch("different", x).join(F.broadcast(scalars), F.lit(True)).where(kept).drop("_bad", "_year")
    return features(watch("final", clean.absolute(x)), config).drop("_day", "_spread")

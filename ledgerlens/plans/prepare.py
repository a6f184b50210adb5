"""Queries over sources, cleaning, features, telemetry, periods and data quality."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import clean, features, quality, split
from ..sources import bucketed, canonical, readers
from ..sources.shared import shared_path
from .base import CONFIG, Query, cleaned, transactions

NOW = datetime(2001, 6, 1)


def raw(spark, d):
    return canonical.transactions(spark, d)


def _merged(spark, d):
    x = raw(spark, d)
    fuel = x.select("vehicle_id", "transaction_timestamp", "transaction_amount", "odometer_miles")
    trips = x.where("distance_miles is not null and mod(odometer_miles, 3) = 0").select("vehicle_id", F.to_date("transaction_timestamp").alias("date"), "distance_miles", "idle_duration_minutes", "driving_duration_minutes", "engine_runtime_minutes")
    return readers.merge(fuel, trips)


def _bucketed(spark, d):
    """Features from the transactions as a bucketed table, which is written first."""
    name = f"transactions_{uuid.uuid4().hex}"
    bucketed.write(raw(spark, d), name, shared_path(spark, name), CONFIG)
    return features.prepared(bucketed.read(spark, name), CONFIG)


def _texts(spark, d):
    """Amounts and times as text, one of them broken now and then, for the type checks."""
    x = raw(spark, d)
    bad = F.col("odometer_miles") % 101 == 0
    return x.withColumns({"transaction_amount": F.when(bad, "n/a").otherwise(F.col("odometer_miles").cast("string")), "transaction_timestamp": F.when(F.col("odometer_miles") % 103 == 0, "invalid").otherwise(F.date_format("transaction_timestamp", "yyyy-MM-dd HH:mm:ss"))})


def _copies(spark, d):
    x = raw(spark, d)
    return x.unionByName(x.where("mod(odometer_miles, 7) = 0"))


_PLAIN = f"canon as ({canonical.SQL})"
QUERIES = {
    "source_scan": Query("location_index n amount:2 first_time last_time", lambda s, d: raw(s, d).groupBy("location_index").agg(F.count(F.lit(1)).alias("n"), F.sum("transaction_amount").alias("amount"), F.min("transaction_timestamp").alias("first_time"), F.max("transaction_timestamp").alias("last_time")),
        "select location_index, count(*) as n, sum(transaction_amount) as amount, min(transaction_timestamp) as first_time, max(transaction_timestamp) as last_time from canon group by 1", _PLAIN, base=False),
    "source_merge": Query("odometer_miles vehicle_id distance_miles:4 idle_duration_minutes:4 engine_runtime_minutes:4", _merged,
        """select c.odometer_miles, c.vehicle_id, t.distance_miles, t.idle_duration_minutes, t.engine_runtime_minutes from canon c left join (
           select vehicle_id, cast(transaction_timestamp as date) as day, sum(distance_miles) as distance_miles, sum(idle_duration_minutes) as idle_duration_minutes, sum(engine_runtime_minutes) as engine_runtime_minutes
           from canon where distance_miles is not null and odometer_miles % 3 = 0 group by all) t on c.vehicle_id = t.vehicle_id and cast(c.transaction_timestamp as date) = t.day""", _PLAIN, base=False),
    "source_slug": Query("product_category slug n", lambda s, d: raw(s, d).groupBy("product_category", "merchant_address").agg(F.count(F.lit(1)).alias("n")).select("product_category", readers.slug_column(F.concat(F.col("product_category"), F.lit("_report, "), F.col("merchant_address"))).alias("slug"), "n"),
        r"""select product_category, array_to_string(list_transform(string_split(x, '-'), lambda p: upper(p[1]) || p[2:]), '-') as slug, n from (
            select product_category, n, trim(substring(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(product_category || '_report, ' || merchant_address)), '[\s_/\\.,:;|]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-'), 1, 40), '-') as x
            from (select product_category, merchant_address, count(*) as n from canon group by all))""", _PLAIN, base=False),
    "clean_blank_to_null": Query("driver_name n", lambda s, d: clean.blank_to_null(raw(s, d)).groupBy("driver_name").agg(F.count(F.lit(1)).alias("n")),
        "select case when not regexp_full_match(driver_name, '\\s*') then driver_name end as driver_name, count(*) as n from canon group by 1", _PLAIN, base=False),
    "clean_required": Query("columns", lambda s, d: s.createDataFrame([(",".join(clean.require(raw(s, d).withColumn("extra", F.lit(1))).columns),)], "columns string"),
        "select 'vehicle_id,driver_name,merchant_name,merchant_address,assigned_location,product_category,vehicle_description,transaction_timestamp,transaction_amount,fuel_volume_gallons,distance_miles,idle_duration_minutes,driving_duration_minutes,engine_runtime_minutes,odometer_miles,vehicle_index,driver_index,location_index' as columns", base=False),
    "clean_rename": Query("card_holder n", lambda s, d: clean.rename(raw(s, d).withColumnRenamed("driver_name", "Card Holder"), {"card_holder": "Card Holder"}).groupBy("card_holder").agg(F.count(F.lit(1)).alias("n")),
        "select driver_name as card_holder, count(*) as n from canon group by 1", _PLAIN, base=False),
    "clean_dedup": Query("n odometer_sum", lambda s, d: _copies(s, d).dropDuplicates().agg(F.count(F.lit(1)).alias("n"), F.sum("odometer_miles").alias("odometer_sum")),
        "select count(*) as n, cast(sum(odometer_miles) as bigint) as odometer_sum from (select distinct * from canon)", _PLAIN, base=False),
    "clean_counts": Query("initial duplicates incomplete final", lambda s, d: clean.counts(_copies(s, d)),
        """select a as initial, a - b as duplicates, b - c as incomplete, c as final from (select (select count(*) + count(*) filter (where odometer_miles % 7 = 0) from canon) as a, (select count(*) from blank) as b, (select count(*) from clean) as c)"""),
    "clean_types": Query("bad_amounts bad_times amount_sum", lambda s, d: clean.types(_texts(s, d)).agg(F.count_if(F.col("transaction_amount").isNull()).alias("bad_amounts"), F.count_if(F.col("transaction_timestamp").isNull()).alias("bad_times"), F.sum(F.col("transaction_amount").cast("long")).alias("amount_sum")),
        "select count(*) filter (where odometer_miles % 101 = 0) as bad_amounts, count(*) filter (where odometer_miles % 103 = 0) as bad_times, cast(sum(case when odometer_miles % 101 <> 0 then odometer_miles end) as bigint) as amount_sum from canon", _PLAIN, base=False),
    "clean_introduced_nulls": Query("column_name introduced", lambda s, d: clean.introduced_nulls(_texts(s, d)),
        """select 'transaction_amount' as column_name, count(*) filter (where odometer_miles % 101 = 0) as introduced from canon union all select 'transaction_timestamp', count(*) filter (where odometer_miles % 103 = 0) from canon""", _PLAIN, base=False),
    "clean_trailing_month": Query("month n", lambda s, d: cleaned(s, d).groupBy(F.date_format("transaction_timestamp", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")),
        "select strftime(transaction_timestamp, '%Y-%m') as month, count(*) as n from clean group by 1"),
    "clean_absolute": Query("distance:2 volume:2", lambda s, d: clean.absolute(raw(s, d).withColumns({"distance_miles": -F.col("distance_miles"), "fuel_volume_gallons": -F.col("fuel_volume_gallons")})).agg(F.sum("distance_miles").alias("distance"), F.sum("fuel_volume_gallons").alias("volume")),
        "select sum(distance_miles) as distance, sum(fuel_volume_gallons) as volume from canon", _PLAIN, base=False),
    "features_dates": Query("odometer_miles date_only year month week_number weekday day_of_month is_weekend", transactions, "select * from tx"),
    "features_clock": Query("odometer_miles hour minute is_business_hours is_morning_rush is_evening_rush is_rush_hour time_of_day_category", transactions, "select * from tx"),
    "features_transaction": Query("odometer_miles product_clean is_diesel_def cost_per_gallon transaction_size_category branch_group", transactions, "select * from tx"),
    "features_bucketed": Query("odometer_miles product_clean fillups_per_day has_eld_activity is_first_transaction_of_day distance_miles:4 is_target", _bucketed, "select * from tx"),
    "features_vehicle": Query("odometer_miles mpg:6 idle_percentage:6 driving_percentage:6", transactions, "select * from tx"),
    "features_fillups_per_day": Query("odometer_miles fillups_per_day", transactions, "select * from tx"),
    "features_flags": Query("odometer_miles no_eld many_fillups", lambda s, d: features.above(features.inverted(transactions(s, d), "has_eld_activity", "no_eld"), "fillups_per_day", 1, "many_fillups"), "select *, not has_eld_activity as no_eld, fillups_per_day > 1 as many_fillups from tx"),
    "features_overnight_hours": Query("is_business_hours n", lambda s, d: features.business_hours(features.clock(features.dates(raw(s, d))), CONFIG.business_hours.__class__(22, 6)).groupBy("is_business_hours").agg(F.count(F.lit(1)).alias("n")),
        "select (hour(transaction_timestamp) >= 22 or hour(transaction_timestamp) < 6) and isodow(transaction_timestamp) < 6 as is_business_hours, count(*) as n from canon group by 1", _PLAIN, base=False),
    "telemetry_mode": Query("days mode", lambda s, d: features.telemetry_mode(features.dates(cleaned(s, d))), "select count(*) as days, case when coalesce(max(n), 0) > 1 then 'granular' else 'daily' end as mode from (select count(distinct distance_miles) as n from f1 group by vehicle_index, date_only)"),
    "telemetry_daily": Query("odometer_miles has_eld_activity is_first_transaction_of_day distance_miles:4", transactions, "select * from tx"),
    "telemetry_granular": Query("odometer_miles has_eld_activity distance_miles:4", lambda s, d: features.telemetry(features.dates(cleaned(s, d)), "granular"), "select odometer_miles, distance_miles is not null as has_eld_activity, distance_miles from f1"),
    "split_period": Query("y0 y1 months current_months status", lambda s, d: split.period(transactions(s, d)), "select * from period"),
    "split_slices": Query("slice row_count", lambda s, d: split.slice_counts(split.in_period(transactions(s, d))),
        """select unnest(['complete', 'target_period', 'peer_period', 'target_historical', 'peer_historical']) as slice, unnest([count(*), count(*) filter (where is_target and in_period), count(*) filter (where not is_target and in_period), count(*) filter (where is_target), count(*) filter (where not is_target)]) as row_count from px"""),
    "split_label": Query("period", lambda s, d: split.label(split.in_period(transactions(s, d)).where("in_period")),
        """select case when year(a) = year(b) then cast(year(b) as varchar) || ' YTD (' || strftime(a, '%b') || '-' || strftime(b, '%b') || ')' else '(' || strftime(a, '%b %Y') || '-' || strftime(b, '%b %Y') || ')' end as period from (select min(transaction_timestamp) as a, max(transaction_timestamp) as b from px where in_period)"""),
    "split_scope": Query("peer_locations first_time last_time row_count", lambda s, d: split.scope(transactions(s, d)),
        "select count(distinct case when not is_target then location_index end) as peer_locations, min(transaction_timestamp) as first_time, max(transaction_timestamp) as last_time, count(*) as row_count from tx"),
    "quality_missing": Query("column_name missing fraction:8", lambda s, d: quality.missing(cleaned(s, d)),
        """select * from (select unnest(['driver_name', 'distance_miles']) as column_name, unnest([count(*) - count(driver_name), count(*) - count(distance_miles)]) as missing, unnest([1 - count(driver_name) / count(*), 1 - count(distance_miles) / count(*)]) as fraction from clean) where missing > 0"""),
    "quality_duplicates": Query("duplicates", lambda s, d: quality.duplicates(_copies(s, d)), "select count(*) + count(*) filter (where odometer_miles % 7 = 0) - (select count(*) from (select distinct * from canon)) as duplicates from canon", _PLAIN, base=False),
    "quality_outliers": Query("column_name q1:4 q3:4 low:4 high:4 outliers percent:6", lambda s, d: quality.outliers(transactions(s, d).select("transaction_amount", "fuel_volume_gallons", "cost_per_gallon", "mpg", "odometer_miles", "hour", "location_index")),
        " union all ".join(f"""select '{c}' as column_name, q1, q3, low, high, outliers, outliers * 100.0e0 / n as percent from (
            select any_value(q1) as q1, any_value(q3) as q3, any_value(greatest(q1 - 1.5e0 * (q3 - q1), 0)) as low, any_value(q3 + 1.5e0 * (q3 - q1)) as high, count(*) as n,
                   count(*) filter (where q3 > q1 and ({c} < greatest(q1 - 1.5e0 * (q3 - q1), 0) or {c} > q3 + 1.5e0 * (q3 - q1))) as outliers
            from tx, (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 from tx)) where outliers > 0""" for c in ("transaction_amount", "fuel_volume_gallons", "cost_per_gallon", "mpg", "odometer_miles"))),
    "quality_validity": Query("future bad_hours", lambda s, d: quality.validity(transactions(s, d), NOW), "select count(*) filter (where transaction_timestamp > timestamp '2001-06-01 00:00:00') as future, count(*) filter (where hour not between 0 and 23) as bad_hours from tx"),
    "quality_grade": Query("issues grade", lambda s, d: quality.grade(quality.duplicates(_copies(s, d)), quality.validity(transactions(s, d), NOW)),
        "select cast(x as integer) as issues, case when x = 0 then 'excellent' when x <= 2 then 'minor issues' else 'multiple issues' end as grade from (select cast((select count(*) from canon where odometer_miles % 7 = 0) > 0 as integer) + cast((select count(*) from tx where transaction_timestamp > timestamp '2001-06-01 00:00:00') > 0 as integer) as x)"),
}

"""The enriched transactions that queries start from, in Spark and as a DuckDB common table, and how a query is written down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import clean, features
from ..sources import canonical

CONFIG = Config()


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(canonical.transactions(spark, sf_dir), CONFIG)


def transactions(spark: SparkSession, sf_dir: str, current: bool = False) -> DataFrame:
    return features.prepared(canonical.transactions(spark, sf_dir), CONFIG, current=current)


#: The same steps for DuckDB: tx has all columns, trimmed to what the oracle queries use.
TX = f"""
canon as ({canonical.SQL}),
blank as (select distinct * replace (case when not regexp_full_match(driver_name, '\\s*') then driver_name end as driver_name, abs(distance_miles) as distance_miles) from canon),
lastm as (select case when date_diff('day', cast(max(transaction_timestamp) as date), last_day(max(transaction_timestamp))) > 5 then strftime(max(transaction_timestamp), '%Y-%m') end as bad from blank),
clean as (select blank.* from blank, lastm where bad is null or strftime(transaction_timestamp, '%Y-%m') <> bad),
f1 as (
  select *, transaction_timestamp as datetime_parsed, cast(transaction_timestamp as date) as date_only, cast(isoyear(transaction_timestamp) as integer) as year,
         strftime(transaction_timestamp, '%Y-%m') as month, cast(weekofyear(transaction_timestamp) as integer) as week_number, cast(isodow(transaction_timestamp) - 1 as integer) as weekday,
         cast(dayofmonth(transaction_timestamp) as integer) as day_of_month, cast(hour(transaction_timestamp) as integer) as hour, cast(minute(transaction_timestamp) as integer) as minute,
         isodow(transaction_timestamp) >= 6 as is_weekend, lower(regexp_replace(coalesce(product_category, 'unknown'), '^\\s+|\\s+$', '', 'g')) as product_clean,
         transaction_amount / nullif(fuel_volume_gallons, 0) as cost_per_gallon, distance_miles / nullif(fuel_volume_gallons, 0) as mpg,
         case when engine_runtime_minutes <> 0 then least(idle_duration_minutes / engine_runtime_minutes * 100, 100) end as idle_percentage, case when engine_runtime_minutes <> 0 then least(driving_duration_minutes / engine_runtime_minutes * 100, 100) end as driving_percentage,
         case when transaction_amount < 50 then 'Small' when transaction_amount <= 150 then 'Medium' when transaction_amount > 150 then 'Large' else 'Unknown' end as transaction_size_category,
         location_index = 4 as is_target, case when location_index = 4 then 'Target' else 'Other Branches' end as branch_group
  from clean),
tx as (
  select * replace (case when is_first_transaction_of_day or granular then distance_miles end as distance_miles) from (
    select f1.*, product_clean in ('diesel', 'def') as is_diesel_def, hour >= 6 and hour < 16 and not is_weekend as is_business_hours,
           hour in (7, 8) as is_morning_rush, hour in (16, 17, 18) as is_evening_rush, hour in (7, 8, 16, 17, 18) as is_rush_hour,
           case when hour < 6 then 'Early Morning' when hour < 12 then 'Morning' when hour < 18 then 'Afternoon' else 'Evening' end as time_of_day_category,
           distance_miles is not null as has_eld_activity,
           count(distinct transaction_timestamp) over (partition by vehicle_index, date_only) as fillups_per_day,
           row_number() over (partition by vehicle_index, date_only order by transaction_timestamp, odometer_miles, transaction_amount) = 1 as is_first_transaction_of_day,
           (select coalesce(max(n), 0) > 1 from (select count(distinct distance_miles) as n from f1 group by vehicle_index, date_only)) as granular
    from f1)),
span as (
  select min(year(transaction_timestamp)) as y0, max(year(transaction_timestamp)) as y1, count(distinct month) as months from tx),
period as (
  select y0, y1, months, (select count(distinct month) from tx, span where year(transaction_timestamp) = y1) as current_months,
         case when y0 = y1 then 'single' when months <= 3 then 'single' when (select count(distinct month) from tx, span where year(transaction_timestamp) = y1) > 3 then 'split' else 'insufficient' end as status
  from span),
px as (select tx.*, coalesce(status <> 'split' or year(transaction_timestamp) = y1, false) as in_period from tx, period),
tp as (select * from px where is_target and in_period)
"""


class Query:
    """A query in both forms. ``columns`` is a list of names, with :digits for those to be rounded."""

    def __init__(self, columns: str, run: Callable[[SparkSession, str], DataFrame], sql: str, ctes: str = "", base: bool = True):
        self.columns, self._run = [(c.partition(":")[0], c.partition(":")[2]) for c in columns.split()], run
        head = ", ".join(x for x in (TX.strip() if base else "", ctes.strip()) if x)
        picked = ", ".join(f"round(cast({c} as double), {d}) as {c}" if d else c for c, d in self.columns)
        self.sql = (f"with recursive {head}\n" if head else "") + f"select {picked} from ({sql})"

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self._run(spark, sf_dir)
        return df.select(*[F.round(F.col(c).cast("double"), int(d)).alias(c) if d else F.col(c) for c, d in self.columns])

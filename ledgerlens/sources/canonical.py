"""The test tables as canonical transactions, in Spark and in DuckDB SQL; deterministic arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = """
  'VIN' || cast(mod(l_partkey, 200) as string) as vehicle_id,
  case when mod(l_orderkey, 997) = 0 then '  ' else 'Driver ' || cast(l_suppkey as string) end as driver_name,
  'Station ' || cast(mod(l_partkey, 40) as string) as merchant_name,
  cast(mod(l_partkey, 40) as string) || ' Main Street' as merchant_address,
  'Branch ' || cast(n_regionkey as string) as assigned_location,
  case l_returnflag when 'R' then 'Gasoline' when 'A' then 'DEF' else ' Diesel ' end as product_category,
  'Unit ' || cast(mod(l_partkey, 200) as string) as vehicle_description,
  @TS@ as transaction_timestamp,
  l_extendedprice * (1 - l_discount) / 300 as transaction_amount,
  l_quantity as fuel_volume_gallons,
  case when mod(l_orderkey * 31 + l_linenumber, 100) < 15 + 5 * n_regionkey then null
       else cast(mod(mod(l_partkey, 200) * 13 + @DOY@ * 7, 300) + 40 as double) end as distance_miles,
  cast(mod(l_orderkey, 120) as double) as idle_duration_minutes,
  cast(mod(l_orderkey * 3, 500) as double) as driving_duration_minutes,
  cast(mod(l_orderkey * 7, 600) as double) as engine_runtime_minutes,
  cast(l_orderkey * 10 + l_linenumber as bigint) as odometer_miles,
  cast(mod(l_partkey, 200) as bigint) as vehicle_index,
  cast(l_suppkey as bigint) as driver_index,
  cast(n_regionkey as bigint) as location_index"""

_SPARK = COLUMNS.replace("@TS@", "l_shipdate + make_dt_interval(0, cast(mod(l_orderkey * 7 + l_linenumber * 5, 24) as int), cast(mod(l_orderkey * 11, 60) as int), 0)").replace("@DOY@", "dayofyear(l_shipdate)")
SQL = "select" + COLUMNS.replace("@TS@", "l_shipdate + to_hours(cast(mod(l_orderkey * 7 + l_linenumber * 5, 24) as bigint)) + to_minutes(cast(mod(l_orderkey * 11, 60) as bigint))").replace("@DOY@", "dayofyear(l_shipdate)") + "\nfrom lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its supplier's region; the two small tables are broadcast by their known sizes, lineitem is never shuffled."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "supplier", "nation")}
    j = t["lineitem"].join(t["supplier"], t["lineitem"].l_suppkey == t["supplier"].s_suppkey).join(t["nation"], t["supplier"].s_nationkey == t["nation"].n_nationkey)
    return j.selectExpr(*_split(_SPARK))


def _split(columns: str) -> list[str]:
    """The expressions of a select list: one starts on each line that has two spaces before it, and goes on after a line that has more."""
    out: list[str] = []
    for line in columns.strip("\n").split("\n"):
        if line.startswith("   "):
            out[-1] += " " + line.strip()
        else:
            out.append(line.strip())
    return [x.rstrip(",") for x in out]

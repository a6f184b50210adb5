"""The canonical transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRINGS = ("vehicle_id", "driver_name", "merchant_name", "merchant_address", "assigned_location", "product_category", "vehicle_description")
DOUBLES = ("transaction_amount", "fuel_volume_gallons", "distance_miles", "idle_duration_minutes", "driving_duration_minutes", "engine_runtime_minutes")
LONGS = ("odometer_miles", "vehicle_index", "driver_index", "location_index")
REQUIRED = (*STRINGS, "transaction_timestamp", *DOUBLES, *LONGS)
OPTIONAL = {"driver_pin": "bigint", "geographic_region": "string"}
TYPES = {c: "string" for c in STRINGS} | {"transaction_timestamp": "timestamp_ntz"} | {c: "double" for c in DOUBLES} | {c: "bigint" for c in LONGS}


def missing(df: DataFrame) -> list[str]:
    """Required columns that df lacks, sorted."""
    return sorted(set(REQUIRED) - set(df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing from here on, so that aggregates skip it."""
    floats = {c for c, k in df.dtypes if k in ("double", "float")}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df

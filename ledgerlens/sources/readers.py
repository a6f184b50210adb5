"""File sources, the fuel and telemetry merge, and sinks."""

from __future__ import annotations

import re
import unicodedata
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConfigError, Sources

#: Names that file systems reserve (fixed values).
RESERVED = {"con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]}


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A Parquet, CSV, JSON or ORC file or folder, by its ending; without one, Parquet. CSV has a header and is read by the schema, as text without one."""
    ending = Path(path.rstrip("/")).suffix.lower().lstrip(".")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ending == "csv":
        return reader.option("header", True).csv(path)
    if ending in ("json", "jsonl"):
        return reader.json(path)
    if ending == "orc":
        return reader.orc(path)
    if ending in ("parquet", ""):
        return reader.parquet(path)
    raise ConfigError(f"no reader for {path}")


def load(spark: SparkSession, sources: Sources, base: str = "") -> DataFrame:
    """The transactions of a configuration; relative paths are from ``base``."""
    at = lambda p: p if "://" in p or p.startswith("/") else f"{base.rstrip('/')}/{p}" if base else p
    if sources.requires_merge:
        return merge(read(spark, at(sources.fuel)), read(spark, at(sources.telemetry)))
    if not sources.merged:
        raise ConfigError("no source file is set")
    return read(spark, at(sources.merged))


def merge(fuel: DataFrame, telemetry: DataFrame, columns: tuple[str, ...] = ("distance_miles", "idle_duration_minutes", "driving_duration_minutes", "engine_runtime_minutes")) -> DataFrame:
    """Fuel transactions with their vehicle-day's telemetry, null where there is none.

    telemetry has vehicle_id, date and the columns, one row for each vehicle-day or several
    trips, which are added up first, so that the join cannot multiply transactions.
    """
    day = telemetry.where("vehicle_id is not null and date is not null").groupBy("vehicle_id", F.to_date("date").alias("_day")).agg(*[F.sum(c).alias(c) for c in columns])
    fuel = fuel.drop(*columns).withColumn("_day", F.to_date("transaction_timestamp"))
    return fuel.join(day, ["vehicle_id", "_day"], "left").drop("_day")


def slug(text: str, limit: int = 40) -> str:
    """A file name of a title: ASCII letters and digits, separators as hyphens, at most ``limit`` characters, in title case."""
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    plain = re.sub(r"[^a-z0-9-]", "", re.sub(r"[\s_/\\.,:;|]+", "-", plain.strip()))
    plain = re.sub(r"-{2,}", "-", plain).strip("-")[:limit].strip("-")
    return (f"{plain}-file" if plain in RESERVED else plain or "unnamed").title()


def slug_column(text: Column, limit: int = 40) -> Column:
    """``slug`` for ASCII texts, as a column."""
    x = F.regexp_replace(F.lower(F.trim(text)), r"[\s_/\\.,:;|]+", "-")
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9-]", ""), r"-{2,}", "-")
    x = F.regexp_replace(F.substring(F.regexp_replace(x, r"^-+|-+$", ""), 1, limit), r"^-+|-+$", "")
    return F.array_join(F.transform(F.split(x, "-"), lambda p: F.initcap(p)), "-")


def write_report(text: str, path: str) -> None:
    """The report sink: a text file on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)

"""Data quality: missing values, copies, outliers, validity, an overall grade."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranges

NOT_MEASURES = {"hour", "vehicle_index", "driver_index", "location_index"}


def _long(one: DataFrame, rows: dict[str, dict[str, str]]) -> DataFrame:
    """One wide row as a row for each column: rows[column][field] is the wide name."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{w}`").alias(n) for n, w in fields.items()]) for c, fields in rows.items()])).alias("x")).select("x.*")


def missing(df: DataFrame) -> DataFrame:
    """(column_name, missing, fraction) of the columns with nulls, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in df.columns])
    x = _long(one, {c: {"missing": f"_{c}", "n": "_n"} for c in df.columns})
    return x.where("missing > 0").select("column_name", "missing", F.try_divide("missing", "n").alias("fraction"))


def duplicates(df: DataFrame) -> DataFrame:
    """One row (duplicates): rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def outliers(df: DataFrame) -> DataFrame:
    """(column_name, q1, q3, low, high, outliers, percent) of numeric columns with values outside max(q1 - 1.5 iqr, 0) .. q3 + 1.5 iqr.

    Two passes: all quartiles, by ranges of counted values, then all counts with the quartiles as one broadcast row.
    """
    cols = [c for c, k in df.dtypes if (k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")) and c not in NOT_MEASURES]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, q1 double, q3 double, low double, high double, outliers long, percent double")
    q = ranges.quantiles(df, {f"_q_{c}": F.col(c) for c in cols}, (0.25, 0.75))
    x = df.select(*cols).join(F.broadcast(q), F.lit(True))

    def bounds(c):
        a, b = F.get(f"_q_{c}", F.lit(0)), F.get(f"_q_{c}", F.lit(1))
        return a, b, F.greatest(a - 1.5 * (b - a), F.lit(0.0)), b + 1.5 * (b - a)

    aggs = []
    for c in cols:
        a, b, low, high = bounds(c)
        aggs += [F.count_if((b > a) & ((F.col(c) < low) | (F.col(c) > high))).alias(f"_n_{c}"), F.first(a).alias(f"_1_{c}"), F.first(b).alias(f"_3_{c}"), F.first(low).alias(f"_l_{c}"), F.first(high).alias(f"_h_{c}")]
    one = x.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    out = _long(one, {c: {"q1": f"_1_{c}", "q3": f"_3_{c}", "low": f"_l_{c}", "high": f"_h_{c}", "outliers": f"_n_{c}", "n": "_rows"} for c in cols})
    return out.where("outliers > 0").select("column_name", "q1", "q3", "low", "high", "outliers", (F.col("outliers") * 100.0 / F.col("n")).alias("percent"))


def validity(df: DataFrame, now: datetime) -> DataFrame:
    """One row (future, bad_hours); the clock is given."""
    return df.agg(F.count_if(F.col("transaction_timestamp") > F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")).alias("future"), F.count_if(~F.col("hour").between(0, 23)).alias("bad_hours"))


def grade(duplicates: DataFrame, validity: DataFrame, minor: int = 2) -> DataFrame:
    """One row (issues, grade)."""
    x = duplicates.join(validity, F.lit(True))
    n = (F.col("duplicates") > 0).cast("int") + (F.col("future") > 0).cast("int") + (F.col("bad_hours") > 0).cast("int")
    return x.select(n.alias("issues"), F.when(n == 0, "excellent").when(n <= minor, "minor issues").otherwise("multiple issues").alias("grade"))

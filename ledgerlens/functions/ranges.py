"""Running counts and quantiles of measures whose different values grow with the data, without a task that sees them all.

Equal values are counted first. A value's range follows from the value alone (64 to a
power of two), so ranges need no sample and are the same wherever they are computed;
their counts, a few hundred rows, are added up, and each range is then ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges to a power of two, and powers below which values share the range of zero.
STEPS, LEAST = 64, -200


def range_of(value: Column) -> Column:
    """A number that rises with the value: at most 2 * 64 * 1224 different ones. NaN is above all, as in Spark's order."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * STEPS) - LEAST * STEPS + 1
    up = F.when(F.abs(v) == float("inf"), 10**6).otherwise(F.greatest(size, F.lit(0)))
    return F.when(v == 0, 0).when(F.isnan(v), 10**6 + 1).when(v > 0, up).otherwise(-up).cast("int")


def running(counted: DataFrame, value: str, counts: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """counted (by, value, counts), a row for each different value, with _before_<count>: the counts of smaller values; _all_<count>: those of all."""
    x = counted.withColumn("_r", range_of(F.col(value)))
    sums = x.groupBy(*by, "_r").agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
    own, order = W.partitionBy(*by), W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_r").alias("_rr"), *[F.coalesce(F.sum(f"_s_{c}").over(order), F.lit(0)).alias(f"_base_{c}") for c in counts], *[F.sum(f"_s_{c}").over(own).alias(f"_all_{c}") for c in counts])
    on = F.col("_r") == F.col("_rr")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = W.partitionBy(*by, "_r").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts}).join(sums, on)
    return x.select(*counted.columns, *[(F.col(f"_base_{c}") + F.col(f"_in_{c}")).alias(f"_before_{c}") for c in counts], *[F.col(f"_all_{c}") for c in counts])


def at_shares(value: str, count: str, shares: tuple[float, ...]) -> list[Column]:
    """Aggregates over ``running``: for each share the two values that its quantile lies between, as a struct (low, high, part)."""
    v, before, n = F.col(value), F.col(f"_before_{count}"), F.col(f"_all_{count}")
    out = []
    for q in shares:
        place = (n - 1) * F.lit(float(q))
        low, high = F.floor(place), F.ceil(place)
        holds = lambda k: (before <= k) & (k < before + F.col(count))
        out.append(F.struct(F.max(F.when(holds(low), v)).alias("low"), F.max(F.when(holds(high), v)).alias("high"), F.max(place - low).alias("part")))
    return out


def between(q: Column) -> Column:
    """The quantile from a struct of ``at_shares``, by linear interpolation."""
    return q["low"] + (q["high"] - q["low"]) * q["part"]


def quantiles(df: DataFrame, measures: dict[str, Column], shares: tuple[float, ...]) -> DataFrame:
    """One row of arrays, one for each measure: its exact quantiles at the shares, nulls left out."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("m"), c.cast("double").alias("v")) for n, c in measures.items()])).alias("x")).select("x.*")
    r = running(each.where("v is not null").groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")), "v", ("n",), ("m",))
    got = r.groupBy("m").agg(*[q.alias(f"q{i}") for i, q in enumerate(at_shares("v", "n", shares))])
    got = got.select("m", F.array(*[between(F.col(f"q{i}")) for i in range(len(shares))]).alias("q"))
    return got.agg(*[F.max(F.when(F.col("m") == n, F.col("q"))).alias(n) for n in measures])

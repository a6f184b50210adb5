"""Rank statistics without global sorts of raw rows: values are counted first, then ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import folds, ranges, stats


def percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average percentile rank (0 to 100) of each non-null value over the whole frame; for entity frames, not raw rows."""
    ties = W.partitionBy(column)
    rank = (F.rank().over(W.orderBy(F.col(column).asc_nulls_last())) + (F.count(F.lit(1)).over(ties) - 1) / 2.0).cast("double")
    n = F.count(column).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), rank / n * 100))


def rank_test(df: DataFrame, value: str, first: str, by: tuple[str, ...] = (), exact: bool = False, ranged: bool = True) -> DataFrame:
    """Mann-Whitney U of the rows where the boolean ``first`` holds against the others, for each group ``by``.

    Returns by, n1, n2, u, cliffs_delta, z, p_value (two-sided normal approximation
    with tie and continuity corrections; null below two values a side). With ``exact``,
    a sample of at most 8 without ties gets its p-value by counting arrangements. The rows are
    reduced to (value, count, count) before the running sums, which go by ranges of values, so
    that no task sees all different values of a group; ``ranged=False`` orders a group at once, for many small groups.
    """
    v = counted(df, value, first, by)
    if ranged:
        return from_counts(ranges.running(v, value, ("_a", "_b"), by), by, exact)
    before = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return from_counts(v.withColumns({f"_before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_a", "_b")}), by, exact)


def counted(df: DataFrame, value: str, first: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, _a, _b): how many rows of either side have each different value."""
    return df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(first)).alias("_a"), F.count_if(~F.col(first)).alias("_b"))


def from_counts(v: DataFrame, by: tuple[str, ...] = (), exact: bool = False, also: tuple = ()) -> DataFrame:
    """``rank_test`` from running counts of ``counted``; ``also`` are further aggregates of the same pass."""
    v = v.withColumns({"_t": F.col("_a") + F.col("_b"), "_below": F.col("_before__a") + F.col("_before__b")})
    ranks = F.col("_a") * (F.col("_below") + (F.col("_t") + 1) / 2.0)
    t = F.col("_t").cast("double")
    g = v.groupBy(*by).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(ranks).alias("_r"), F.sum(t * t * t - t).alias("_ties"), *also)
    more = [c for c in g.columns if c not in (*by, "n1", "n2", "_r", "_ties")]
    g = g.withColumn("u", F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    mean, var = n1 * n2 / 2, n1 * n2 / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)), F.sqrt(var)) * F.when(F.col("u") < mean, -1).otherwise(1)
    g = g.withColumns({"cliffs_delta": F.try_divide(2 * F.col("u"), n1 * n2) - 1, "z": F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), z)})
    g = g.withColumn("p_value", F.expr(stats.two_sided_p_sql("z")))
    if exact:
        few = (F.least("n1", "n2") <= 8) & (F.col("_ties") == 0) & F.col("z").isNotNull()
        g = g.withColumn("p_value", F.when(few, folds.exact_u_p(F.when(few, F.col("u")), F.col("n1"), F.col("n2"))).otherwise(F.col("p_value")))
    return g.select(*by, "n1", "n2", "u", "cliffs_delta", "z", "p_value", *more)


def rank_test_sql(source: str, value: str, first: str, by: str = "") -> str:
    """``rank_test`` as a DuckDB query over raw rows."""
    cols = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    part = f"partition by {by} " if by else ""
    inner = f"""
      select {cols}cast(count(*) filter (where {first}) as double) as n1, cast(count(*) filter (where not {first}) as double) as n2,
             sum(case when {first} then r else 0 end) as rs, sum(ties) as ties
      from (select {cols}{first}, (rank() over ({part}order by {value}) + (count(*) over (partition by {cols}{value}) - 1) / 2.0e0) as r,
                   (power(count(*) over (partition by {cols}{value}), 2) - 1) as ties
            from {source} where {value} is not null and {first} is not null) {group}"""
    u = f"select *, rs - n1 * (n1 + 1) / 2.0e0 as u from ({inner})"
    z = f"""select *, case when n1 >= 2 and n2 >= 2 then greatest(abs(u - n1 * n2 / 2) - 0.5e0, 0)
      / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))), 0) * (case when u < n1 * n2 / 2 then -1 else 1 end) end as z from ({u})"""
    return f"select {cols}cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, u, 2 * u / nullif(n1 * n2, 0) - 1 as cliffs_delta, z, {stats.two_sided_p_sql('z')} as p_value from ({z})"


def exact_sql(source: str) -> str:
    """``rank_test_sql``'s p_value replaced by the exact one where a sample has at most 8 values; source has n1, n2, u, p_value and whether all values are different."""
    few = "\"distinct\" and least(n1, n2) <= 8 and n1 >= 2 and n2 >= 2"
    low = "cast(floor(least(u, n1 * n2 - u)) as bigint)"
    part = "w.a[t + 1] - case when t >= w.b + w.i + 1 then w.a[t - w.b - w.i] else 0 end"
    return f"""
      with recursive w as (
        select *, 0 as i, 1.0e0 as ways, list_transform(range(low + 1), lambda t: case when t = 0 then 1.0e0 else 0.0e0 end) as a
        from (select distinct least(n1, n2) as k, greatest(n1, n2) as b, {low} as low from {source} where {few})
        union all
        select w.k, w.b, w.low, w.i + 1, w.ways * (w.b + w.i + 1) / (w.i + 1),
          list_transform(range(w.low + 1), lambda s: list_sum(list_transform(range(s // (w.i + 1) + 1), lambda j: list_transform([s - j * (w.i + 1)], lambda t: {part})[1])))
        from w where w.i < w.k)
      select x.* replace (case when {few} then least(1.0e0, 2 * list_sum(w.a) / w.ways) else p_value end as p_value)
      from {source} x left join w on w.i = w.k and w.k = least(n1, n2) and w.b = greatest(n1, n2) and w.low = {low}"""


def benjamini_hochberg(df: DataFrame, p: str = "p_value", alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds q_value and rejected over a family of tests (a row each); a p that isn't finite counts as 1."""
    clean = F.least(F.greatest(F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    every = W.partitionBy(*by)
    x = df.withColumn("_p", clean).withColumn("_k", F.row_number().over(every.orderBy("_p"))).withColumn("_m", F.count(F.lit(1)).over(every))
    q = F.min(F.least(F.col("_m") / F.col("_k") * F.col("_p"), F.lit(1.0))).over(every.orderBy(F.desc("_k")))
    last = F.max(F.when(F.col("_p") <= F.col("_k") / F.col("_m") * alpha, F.col("_k"))).over(every)
    return x.withColumns({"q_value": q, "rejected": F.coalesce(F.col("_k") <= last, F.lit(False))}).drop("_p", "_k", "_m")


def bh_sql(source: str, alpha: float = 0.05) -> str:
    return f"""select * exclude (pc, k, m), min(least(m * 1.0e0 / k * pc, 1.0e0)) over (order by k desc) as q_value,
      coalesce(k <= max(case when pc <= k * 1.0e0 / m * {alpha} then k end) over (), false) as rejected
      from (select *, row_number() over (order by pc) as k, count(*) over () as m
            from (select *, least(greatest(coalesce(p_value, 1.0e0), 0.0e0), 1.0e0) as pc from ({source})))"""


def cohens_d(df: DataFrame, value: str, first: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's d with the pooled deviation; null below two values a side or without spread."""
    a, b = F.when(F.col(first), F.col(value)), F.when(~F.col(first), F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return g.withColumn("cohens_d", F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), F.try_divide(F.col("m1") - F.col("m2"), pooled))).select(*by, "n1", "n2", "m1", "m2", "cohens_d")

"""Computations on short sorted arrays as folds inside one row: segmentation, Kendall's S, exact rank-test probabilities.

A series of months is an array of a few hundred values at most, so all of this is one
expression over it: no join of a series with itself. What needs all pairs of its values is
made for many series at once, with numpy in Python workers (``measured``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def deviation(xs: Column) -> Column:
    """Sample deviation of an array without nulls; null below two values.

    Each value in turn moves the mean and adds its distance to the old mean times that to the new one, which are DuckDB's
    steps and roundings; Spark's own aggregate multiplies otherwise and differs in the last bit.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))

    def step(a, x):
        return let(a["m"] + (x - a["m"]) / (a["n"] + 1), lambda m: F.struct((a["n"] + 1).alias("n"), m.alias("m"), (a["d"] + (x - m) * (x - a["m"])).alias("d")))

    return F.when(F.size(xs) >= 2, F.aggregate(xs, start, step, lambda a: F.sqrt(a["d"] / (a["n"] - 1))))


def ordered(order: str, value: str) -> tuple[Column, Column]:
    """Aggregates: a group's values without nulls in their order, and the order's keys beside them."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("k"), F.col(value).cast("double").alias("v")))))
    return F.transform(pairs, lambda p: p["v"]), F.transform(pairs, lambda p: p["k"])


def kendall_s(v: Column) -> Column:
    """Later values above earlier ones less those below."""
    return total(F.transform(v, lambda a, i: total(F.transform(F.slice(v, i + 2, F.size(v)), lambda b: F.signum(b - a)))))


def ties(v: Column) -> Column:
    """The sum of t (t - 1) (2 t + 5) over groups of t equal values."""

    def term(x):
        return let(F.size(F.filter(v, lambda y: y == x)).cast("double"), lambda t: t * (t - 1) * (2 * t + 5))

    return total(F.transform(F.array_distinct(v), term))


def exact_u_p(u: Column, n: Column, m: Column) -> Column:
    """Two-sided exact p of Mann-Whitney's U without ties; null for null.

    Arrangements by U are the coefficients of the product of (1 - q^(b + i)) / (1 - q^i) for i up to a, a and b being the
    smaller and the larger sample; a fold multiplies and divides the array of them up to the smaller tail.
    """
    low = F.floor(F.least(u, n * m - u)).cast("int")
    spots = F.sequence(F.lit(0), low)

    def multiplied(ways, i, b):
        return F.transform(ways, lambda x, t: x - F.coalesce(F.get(ways, t - (b + i)), F.lit(0.0)))

    def divided(ways, i):
        return F.aggregate(F.sequence(F.lit(0), F.size(ways) - 1), F.array().cast("array<double>"), lambda done, t: F.concat(done, F.array(F.get(ways, t) + F.coalesce(F.get(done, t - i), F.lit(0.0)))))

    def p(a, b):
        first = F.transform(spots, lambda t: F.when(t == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        steps = F.sequence(F.lit(1), a)
        ways = F.aggregate(steps, first, lambda w, i: let(multiplied(w, i, b), lambda x: divided(x, i)), lambda w: total(w))
        return F.least(F.lit(1.0), 2 * ways / F.aggregate(steps, F.lit(1.0), lambda c, i: c * (b + i) / i))

    return F.when(u.isNotNull(), let(F.least(n, m).cast("int"), lambda a: let(F.greatest(n, m).cast("int"), lambda b: p(a, b))))


#: Numbers of the kernels that a worker holds at once.
KERNEL = 1 << 18


def _measured(x: np.ndarray, least: int, step: int, penalty: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Kendall's S, ties and breaks of series of one length, a row each; penalties and gammas that are NaN are the usual ones."""
    count, n = x.shape
    gap = x[:, :, None] - x[:, None, :]
    upper = np.triu_indices(n, 1)
    beside = gap[:, upper[0], upper[1]]
    s = -np.sign(beside).sum(axis=1)
    same = ((x[:, :, None] == x[:, None, :]) | (np.isnan(x)[:, :, None] & np.isnan(x)[:, None, :])).sum(axis=2).astype(float)
    ties = ((same - 1) * (2 * same + 5)).sum(axis=1)
    if n < max(2, least):
        return s, ties, [[] for _ in range(count)]
    middle = (beside.shape[1] - 1) // 2, beside.shape[1] // 2
    part = np.partition(beside * beside, middle, axis=1)
    median = (part[:, middle[0]] + part[:, middle[1]]) / 2
    gamma = np.where(np.isnan(gamma), np.where(median > 0, 1 / np.where(median > 0, median, 1.0), 1.0), gamma)
    near = np.exp(-np.clip(gamma[:, None, None] * gap * gap, 1e-2, 1e2))
    near[:, range(n), range(n)] = 1.0
    points = [k for k in range(n) if k == 0 or (k % step == 0 and k >= least)] + [n]
    ends = len(points) - 1
    # sums of cells between points, then running sums along both sides
    sums = np.zeros((count, ends + 1, ends + 1))
    sums[:, 1:, 1:] = np.add.reduceat(np.add.reduceat(near, points[:-1], axis=2), points[:-1], axis=1).cumsum(axis=1).cumsum(axis=2)
    fine = np.where(np.isnan(penalty), 2 * np.log(n), penalty)
    best, back = np.full((count, ends + 1), np.inf), np.zeros((count, ends + 1), int)
    best[:, 0] = -fine
    for e in range(1, ends + 1):
        begins = np.array([i for i in range(e) if points[e] - points[i] >= least], int)
        if len(begins):
            size = np.array([points[e] - points[i] for i in begins], float)
            scatter = sums[:, e, e, None] - sums[:, begins, e] - sums[:, e, begins] + sums[:, begins, begins]
            tried = best[:, begins] + (size - scatter / size) + fine[:, None]
            first = tried.argmin(axis=1)
            best[:, e], back[:, e] = tried[range(count), first], begins[first]
    out = []
    for row in back.tolist():
        found, e = [], ends
        while row[e] > 0:
            e = row[e]
            found.append(points[e])
        out.append(found[::-1])
    return s, ties, out


def measured(v: Column, least: int = 2, step: int = 5, penalty: Column | None = None, gamma: Column | None = None) -> Column:
    """A struct (s, ties, breaks) of an array without nulls: ``kendall_s``, ``ties`` and ``breaks``, from one table of its values' differences.

    The table has a number for each pair of values, which the JVM would make one expression at a time; here numpy makes those of many
    arrays of one length at once. Null for null.
    """

    @F.pandas_udf("s double, ties double, breaks array<int>")
    def run(v: pd.Series, penalty: pd.Series, gamma: pd.Series) -> pd.DataFrame:
        s, ties, breaks = [None] * len(v), [None] * len(v), [None] * len(v)
        rows: dict[int, list[int]] = {}
        for i, x in enumerate(v):
            if x is not None:
                rows.setdefault(len(x), []).append(i)
        for n, of in rows.items():
            size = max(1, KERNEL // max(1, n * n))
            for k in range(0, len(of), size):
                at = of[k : k + size]
                found = _measured(np.stack([v.iloc[i] for i in at]).astype(float), least, step, penalty.iloc[at].to_numpy(float), gamma.iloc[at].to_numpy(float))
                for i, a, b, c in zip(at, *found):
                    s[i], ties[i], breaks[i] = a, b, c
        return pd.DataFrame({"s": s, "ties": ties, "breaks": breaks})

    null = F.lit(None).cast("double")
    return run(v, null if penalty is None else penalty, null if gamma is None else gamma)


def breaks(v: Column, least: int = 2, step: int = 5, penalty: Column | None = None, gamma: Column | None = None) -> Column:
    """Where the optimal segments of an array begin, without 0, ascending.

    The cost of a segment is its radial basis scatter, each break costs ``penalty`` (2 ln n), a segment has ``least``
    values or more and breaks lie at multiples of ``step``. ``gamma`` is one over the median squared distance, or 1 where
    that is 0. Of equal optima the one whose last segment is longest is taken.
    """
    return measured(v, least, step, penalty, gamma)["breaks"]


def change_points(v: Column, keys: Column, least: int = 2, min_length: int = 6, shift: int = -1, step: int = 5, found: Column | None = None) -> Column:
    """The keys at the ``breaks`` of an array, unless they are ``found`` before: the last before each (``shift`` -1) or the first after (0); null for series that are short or constant."""
    found = F.transform(breaks(v, least, step) if found is None else found, lambda e: F.get(keys, e + shift))
    return F.when((F.size(v) >= min_length) & (F.array_min(v) < F.array_max(v)), found)


def segments(series: DataFrame, by: tuple[str, ...], order: str, value: str, **how) -> DataFrame:
    """(by, change_points) of each series that is long enough and not constant."""
    v, keys = ordered(order, value)
    # few bytes but much work: partitions by number, which adaptive execution doesn't put together
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = series.repartition(parts, *by).groupBy(*by).agg(v.alias("_v"), keys.alias("_k")).withColumn("change_points", change_points(F.col("_v"), F.col("_k"), **how))
    return x.where(F.col("change_points").isNotNull()).select(*by, "change_points")

"""Operators without a closed form: numpy in Python workers, on data that was aggregated before."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables of the margins that are no likelier.

    Likelihoods fall on both sides of the mode, so each tail begins at a place found by bisection
    and is summed outward until its terms no longer count.
    """
    n1, n2, k = a + b, c + d, a + c
    if min(a, b, c, d) < 0 or n1 + n2 == 0:
        return float("nan")
    log, low, high = math.lgamma, max(0, k - n2), min(k, n1)

    def term(x):
        return log(n1 + 1) - log(x + 1) - log(n1 - x + 1) + log(n2 + 1) - log(k - x + 1) - log(n2 - k + x + 1)

    whole = log(n1 + n2 + 1) - log(k + 1) - log(n1 + n2 - k + 1)
    mode = min(high, max(low, (n1 + 1) * (k + 1) // (n1 + n2 + 2)))
    # lgamma is exact to a relative 1e-15 or so: equal likelihoods may differ by that
    most = term(a) + max(1e-7, 1e-15 * log(n1 + n2 + 1))
    if term(mode) <= most:
        return 1.0

    def tail(end, step):
        inside, outside = mode, end + step  # likelier than a; not
        while abs(outside - inside) > 1:
            x = (inside + outside) // 2
            inside, outside = (inside, x) if term(x) <= most else (x, outside)
        x, total = outside, 0.0
        ratio = math.exp(term(x) - whole) if low <= x <= high else 0.0
        while low <= x <= high and ratio > total * 1e-17:
            total += ratio
            up, down = ((n1 - x) * (k - x), (x + 1) * (n2 - k + x + 1)) if step > 0 else (x * (n2 - k + x), (n1 - x + 1) * (k - x + 1))
            ratio, x = ratio * up / down, x + step
        return total

    return min(1.0, tail(low, -1) + tail(high, 1))


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(w + x + y + z) else fisher_exact(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype=float)


#: Different values that a task of the bootstrap holds, and tasks among which replicates are dealt while there are few blocks.
BLOCK, DEALT = 20_000, 64
#: Rows for each different value of a block up to which its rows are drawn rather than shares of its values.
SINGLY = 2


@dataclass(frozen=True)
class Statistic:
    """A statistic of a resample, as sums over blocks of its values in ascending order.

    ``parts`` gives a block's terms from its values (a row for each column), their weights, the resampled rows before the
    block and all resampled rows; ``value`` makes the statistic of the terms' sums over all blocks, as columns. Where the
    terms are nothing but the values at some ranks of a resample, ascending from 0, ``ranks`` gives those for the number of rows.
    """

    terms: int
    parts: Callable[[np.ndarray, np.ndarray, int, int], tuple[float, ...]]
    value: Callable[[list[Column], int], Column]
    ranks: Callable[[int], tuple[int, ...]] | None = None


def mean() -> Statistic:
    return Statistic(1, lambda x, w, first, n: (w @ x[0],), lambda s, n: s[0] / float(max(1, n)))


def ratio() -> Statistic:
    """The first column's sum over the second's."""
    return Statistic(2, lambda x, w, first, n: (w @ x[0], w @ x[1]), lambda s, n: F.try_divide(s[0], s[1]))


def quantile(share: float) -> Statistic:
    """By linear interpolation between the two nearest ranks."""

    def parts(x, w, first, n):
        place, upto = (n - 1) * share, np.cumsum(w)
        at = [k - first for k in (math.floor(place), math.ceil(place))]
        return tuple(float(x[0][np.searchsorted(upto, k, side="right")]) if 0 <= k < upto[-1] else 0.0 for k in at)

    return Statistic(2, parts, lambda s, n: s[0] + (s[1] - s[0]) * ((n - 1) * share - math.floor((n - 1) * share)), lambda n: (math.floor((n - 1) * share), math.ceil((n - 1) * share)))


def trimmed_mean(share: float) -> Statistic:
    """The mean without that share of the rows at either end."""

    def parts(x, w, first, n):
        cut, upto = int(share * n), np.cumsum(w)
        kept = np.clip(np.minimum(upto + first, n - cut) - np.maximum(upto - w + first, cut), 0, None)
        return (kept @ x[0],)

    return Statistic(1, parts, lambda s, n: s[0] / float(max(1, n - 2 * int(share * n))))


def _ranked(resamples: int, n: int, ranks: tuple[int, ...], seed: int) -> np.ndarray:
    """(resample, rank): the rows, numbered by value from 0, that stand at ascending ranks of a resample of n rows.

    A resample's rows are n independent uniform numbers cut into n equal parts. The least of m of them that lie above a
    number is beyond it by a beta share of what is left, and so is the k-th least, so a rank needs no other draw.
    """
    rng, below, done, out = np.random.default_rng((seed, n)), np.zeros(resamples), 0, []
    for k in ranks:
        if k + 1 > done:
            below = below + (1 - below) * rng.beta(k + 1 - done, n - k, resamples)
            done = k + 1
        out.append(np.minimum((below * n).astype(np.int64), n - 1))
    return np.array(out, np.int64).reshape(len(ranks), resamples).T


def _at_ranks(x: DataFrame, total: int, statistic: Statistic, resamples: int, seed: int) -> DataFrame:
    """(replicate, t0, t1, ...): the values at a statistic's ranks in each resample, looked up in ``ranges.running`` counts."""
    ranks = statistic.ranks(total)
    rows = _ranked(resamples, total, ranks, seed).ravel()
    order = np.argsort(rows, kind="stable")
    places = rows[order]

    def found(parts):
        for part in parts:
            begin = np.searchsorted(places, part["_before_c"].to_numpy(np.int64))
            size = np.searchsorted(places, part["_before_c"].to_numpy(np.int64) + part["c"].to_numpy(np.int64)) - begin
            at = order[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            values, term = np.repeat(part["v"].to_numpy(float), size), at % len(ranks)
            yield pd.DataFrame({"replicate": at // len(ranks)} | {f"t{i}": np.where(term == i, values, 0.0) for i in range(len(ranks))})

    near = x.where((F.col("_before_c") <= int(places[-1])) & (F.col("_before_c") + F.col("c") > int(places[0]))).select("v", "c", "_before_c")
    return near.mapInPandas(found, "replicate long, " + ", ".join(f"t{i} double" for i in range(len(ranks))))


def _drawn(x: DataFrame, names: list[str], sizes: dict[int, int], statistic: Statistic, resamples: int, seed: int) -> DataFrame:
    """(replicate, t0, t1, ...): a statistic's terms of each resample and block."""
    total, numbers = sum(sizes.values()), sorted(sizes)
    share = np.array([sizes[i] for i in numbers]) / total
    deals = max(1, DEALT // len(numbers))
    terms = [f"t{i}" for i in range(statistic.terms)]

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        block, deal = numbers.index(int(key[0])), int(key[1])
        part = part.sort_values(names)
        v, c = np.ascontiguousarray(part[names].to_numpy(float).T), part["c"].to_numpy(np.int64)
        p, reps, sums = c / c.sum(), np.arange(deal, resamples, deals), []
        holder = np.repeat(np.arange(len(c), dtype=np.int32), c) if c.sum() <= SINGLY * len(c) else None
        for r in reps.tolist():
            shares = np.random.default_rng((seed, r)).multinomial(total, share) if len(numbers) > 1 else np.array([total])
            rng = np.random.default_rng((seed, r, block))
            if holder is None:
                drawn = rng.multinomial(shares[block], p)
            else:  # few rows a value: the rows themselves are drawn
                drawn = np.bincount(holder[rng.integers(0, len(holder), shares[block], dtype=np.int32)], minlength=len(c))
            sums.append(statistic.parts(v, drawn, int(shares[:block].sum()), total))
        return pd.DataFrame(np.array(sums, float).reshape(len(reps), len(terms)), columns=terms).assign(replicate=reps)[["replicate", *terms]]

    # few bytes but much work: partitions by number, which adaptive execution doesn't put together
    rows = x.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartition(max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), DEALT), "block", "deal")
    return rows.groupBy("block", "deal").applyInPandas(run, "replicate long, " + ", ".join(f"{t} double" for t in terms))


def bootstraps(values: DataFrame, asked: dict[str, tuple[Statistic, str, str | None]], resamples: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(statistic, low, high): percentile intervals of statistics, each of one column or two, over resamples as large as the data; nulls without values.

    Equal values are counted, once for all statistics of the same columns, and dealt, in ascending order, to blocks of about ``BLOCK`` different ones;
    pairs of values, for statistics of two columns, by their hash. In a resample each block gets a multinomial share of the draws and each of
    its values a multinomial share of those, which is the same as drawing rows one by one. Shares of blocks follow from
    the seed and the resample's number, so all tasks agree on them and know how many rows lie before their block; a task
    holds its block alone, and the driver sees the blocks' sizes. A statistic of single ranks needs no resample in full: the
    rank's place among all rows is drawn from its own distribution.
    """
    spark, found, kept = values.sparkSession, {}, []
    try:
        columns = sorted({(c, o) for _, c, o in asked.values()}, key=str)
        if len(columns) > 1:
            values = values.select(*sorted({c for pair in columns for c in pair if c})).persist()
            kept.append(values)
        for column, other in columns:
            names = ["v"] if other is None else ["v", "w"]
            x = values.select(*[F.col(c).cast("double").alias(n) for c, n in zip((column, other), names)]).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("c"))
            if other is None:
                x = ranges.running(x.withColumn("d", F.lit(1)), "v", ("c", "d")).select("v", "c", "_before_c", F.floor(F.col("_before_d") / BLOCK).cast("int").alias("block"))
            else:
                x = x.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(max(1, -(-x.count() // BLOCK)))).cast("int"))
            kept.append(x.persist())
            sizes = {k: n for k, n in x.groupBy("block").agg(F.sum("c")).collect()}
            total = sum(sizes.values())
            for name, (statistic, c, o) in asked.items():
                if (c, o) != (column, other):
                    continue
                if not total:
                    found[name] = (None, None)
                    continue
                drawn = _at_ranks(x, total, statistic, resamples, seed) if statistic.ranks and other is None else _drawn(x, names, sizes, statistic, resamples, seed)
                sums = drawn.groupBy("replicate").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(statistic.terms)])
                made = sums.select(statistic.value([F.col(f"t{i}") for i in range(statistic.terms)], total).alias("value"))
                found[name] = tuple(made.agg(F.percentile("value", F.lit(alpha / 2)), F.percentile("value", F.lit(1 - alpha / 2))).first())
    finally:
        for x in kept:
            x.unpersist()
    return spark.createDataFrame([(name, *found[name]) for name in asked], "statistic string, low double, high double")


def bootstrap(values: DataFrame, column: str, resamples: int = 10_000, seed: int = 42, alpha: float = 0.05, statistic: Statistic | None = None, other: str | None = None) -> DataFrame:
    """(low, high) of the percentile interval of one statistic (the mean), as in ``bootstraps``."""
    return bootstraps(values, {"": (statistic or mean(), column, other)}, resamples, seed, alpha).select("low", "high")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, vif) by uncentred regression of each feature on the others, from one pass over their products."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing features: {', '.join(lacking)}")
    x = [F.col(c).cast("double") for c in columns]
    finite = F.lit(True)
    for c in x:
        finite &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    k = len(columns)
    row = df.where(finite).agg(*[F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)) for i in range(k) for j in range(i, k)]).first()
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = row
    gram = gram + gram.T - np.diag(np.diag(gram))
    try:
        out = np.diag(gram) * np.diag(np.linalg.inv(gram))
    except np.linalg.LinAlgError:
        out = np.full(k, np.inf)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, out)], "feature string, vif double")

"""Target against peers: proportion tests, cost distribution, false-discovery control, exposure, skewness advice."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import ranges, ranks, stats, workers

FLAGS = {"No ELD Match": "not has_eld_activity", "Non-Diesel/DEF": "not is_diesel_def", "After-Hours": "not is_business_hours", "Multiple Same-Day Fillups": "coalesce(fillups_per_day > 1, false)"}


def counts(df: DataFrame, flags: dict[str, str] = FLAGS) -> DataFrame:
    """(metric, a, n1, b, n2): hits and rows of target and peers for all flags, in one pass; a test without rows on a side is left out."""
    one = df.agg(F.count_if("is_target").alias("n1"), F.count_if(~F.col("is_target")).alias("n2"), *[F.count_if(F.expr(f"is_target and {c}")).alias(f"a{i}") for i, c in enumerate(flags.values())], *[F.count_if(F.expr(f"not is_target and {c}")).alias(f"b{i}") for i, c in enumerate(flags.values())])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a{i}").alias("a"), F.col("n1"), F.col(f"b{i}").alias("b"), F.col("n2")) for i, m in enumerate(flags)])
    return one.select(F.explode(rows).alias("x")).select("x.*").where("n1 > 0 and n2 > 0")


def proportions(c: DataFrame, alpha: float = 0.05, continuity: bool = False) -> DataFrame:
    """All tests of each row of ``counts``."""
    tests = stats.two_by_two_sql("a", "n1", "b", "n2", alpha, continuity)
    x = c.select("*", *[F.expr(e).alias(k) for k, e in tests.items() if k != "p_value"])
    return x.withColumn("p_value", F.expr(tests["p_value"]))


def cost(df: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: the amounts of target and peers, their rank test and effect, all from one table of counted amounts."""
    v, c = F.col("transaction_amount"), ranks.counted(df, "transaction_amount", "is_target")
    also = []
    for n, k in (("target", "_a"), ("peer", "_b")):
        also += [F.try_divide(F.sum(v * F.col(k)), F.sum(k)).alias(f"mean_{n}"), F.sum(v * F.col(k)).alias(f"total_{n}")]
        also += [q.alias(f"_{p}_{n}") for p, q in zip(("p25", "median", "p75"), ranges.at_shares("transaction_amount", k, (0.25, 0.5, 0.75)))]
    x = ranks.from_counts(ranges.running(c, "transaction_amount", ("_a", "_b")), also=tuple(also))
    for n in ("target", "peer"):
        x = x.withColumns({f"{p}_{n}": ranges.between(F.col(f"_{p}_{n}")) for p in ("p25", "median", "p75")}).drop(*[f"_{p}_{n}" for p in ("p25", "median", "p75")])
    diff, cuts = F.col("mean_target") - F.col("mean_peer"), config.effect_sizes.cliff
    d = F.when(F.abs("cliffs_delta") < cuts[0], "negligible").when(F.col("cliffs_delta") > 0, "higher").otherwise("lower")
    return x.withColumns({"mean_difference": diff, "percent_difference": F.try_divide(diff, "mean_peer") * 100, "direction": d, "magnitude": F.expr(stats.band_sql("cliffs_delta", cuts, stats.CLIFF_NAMES))})


def magnitudes(tests: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds the bands of risk ratio, odds ratio and risk difference to ``proportions``; ratios below 1 go by their inverse."""
    e = config.effect_sizes
    gap = F.abs(F.col("rate_1") - F.col("rate_2"))
    far = lambda c: F.greatest(F.col(c), F.try_divide(F.lit(1.0), F.col(c)))
    x = tests.withColumns({"_rr": far("risk_ratio"), "_or": far("odds_ratio"), "_rd": gap})
    for name, column, cuts in (("risk_ratio", "_rr", e.risk_ratio), ("odds_ratio", "_or", e.odds_ratio), ("risk_difference", "_rd", e.risk_difference)):
        x = x.withColumn(f"{name}_band", F.expr(stats.band_sql(column, cuts, stats.RATIO_NAMES)))
    return x.drop("_rr", "_or", "_rd")


def standardised(df: DataFrame, value: str, first: str, config: Config = Config()) -> DataFrame:
    """Cohen's d of a value with its band."""
    return ranks.cohens_d(df, value, first).withColumn("magnitude", F.expr(stats.band_sql("cohens_d", config.effect_sizes.cohen, stats.CLIFF_NAMES)))


def family(df: DataFrame, config: Config = Config()) -> DataFrame:
    """The key-metric family: four proportion tests and the cost distribution, with q-values over all of them.

    A test that has no answer isn't of the family: rows that all have a flag, or none of them, and amounts with fewer than
    two values on a side.
    """
    alpha = config.statistics.alpha
    p = proportions(counts(df).where("a + b between 1 and n1 + n2 - 1"), alpha).select("metric", F.col("z").alias("statistic"), F.col("cramers_v").alias("effect"), "p_value")
    c = ranks.rank_test(df, "transaction_amount", "is_target").select(F.lit("Cost Distribution").alias("metric"), F.col("u").alias("statistic"), F.col("cliffs_delta").alias("effect"), "p_value")
    x = ranks.benjamini_hochberg(p.unionByName(c.where("p_value is not null")), "p_value", alpha)
    return x.withColumn("p_band", F.expr(stats.p_band_sql("p_value")))


def executive(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Significant tests by p: odds ratio, risk difference (notable from 0.05) and, for costs, the probability of superiority."""
    f = family(df, config).where("rejected")
    t = proportions(counts(df), config.statistics.alpha).select("metric", "odds_ratio", (F.col("rate_1") - F.col("rate_2")).alias("risk_difference"))
    x = f.join(F.broadcast(t), "metric", "left")  # a row for each test
    x = x.withColumns({"notable": F.coalesce(F.abs("risk_difference") >= 0.05, F.lit(False)), "superiority": F.when(F.col("metric") == "Cost Distribution", (F.abs("effect") + 1) / 2)})
    return x.select("metric", "p_value", "odds_ratio", "risk_difference", "notable", "superiority").orderBy("p_value", "metric")


def exposure(df: DataFrame, config: Config = Config(), interval: bool = True) -> DataFrame:
    """One row (excess, mean_unverified, exposure, exposure_low, exposure_high) if the target's unverified rate is significantly higher; else none.

    The bounds are those of the mean's bootstrap interval times the excess; without ``interval`` they are left out. The interval
    is computed at once, from the three columns that the test and the mean need too: they are kept until it is there.
    """
    alpha = config.statistics.alpha
    if interval:
        rows = df.select("is_target", "has_eld_activity", "transaction_amount").persist()
        try:
            one = exposure(rows, config, interval=False).collect()
            ci = workers.bootstrap(rows.where("is_target and not has_eld_activity"), "transaction_amount", config.performance.n_bootstrap, alpha=alpha).first() if one else None
        finally:
            rows.unpersist()
        made = [(x.excess, x.mean_unverified, x.exposure, *(None if end is None else x.excess * end for end in ci)) for x in one]
        return df.sparkSession.createDataFrame(made, "excess long, mean_unverified double, exposure double, exposure_low double, exposure_high double")
    t = proportions(counts(df, {"No ELD Match": FLAGS["No ELD Match"]}), alpha)
    mine = df.where("is_target and not has_eld_activity")
    x = t.join(F.broadcast(mine.agg(F.avg("transaction_amount").alias("mean_unverified"))), F.lit(True)).withColumn("excess", ((F.col("rate_1") - F.col("rate_2")) * F.col("n1")).cast("long"))
    found = F.struct("excess", "mean_unverified", (F.col("excess") * F.col("mean_unverified")).alias("exposure"))
    # not a filter, which would be pushed below and repeat what z is made of many times
    return x.select(F.explode(F.when((F.col("p_value") < alpha) & (F.col("excess") > 0), F.array(found))).alias("x")).select("x.*")


def log_advice(df: DataFrame, column: str) -> DataFrame:
    """One row: shape of a column's distribution and whether log1p is advised.

    Two passes: quantiles and moments, then the median deviations and the tail with those
    as a broadcast row. Advice needs 30 values, none negative, one sign of a long tail
    and a drop of a fifth in the ratio of median deviation to median.
    """
    v = F.col(column)
    x = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"), F.log1p(F.greatest(v, F.lit(0.0))).alias("lv"))
    one = x.agg(F.count("v").alias("n"), F.min("v").alias("lowest"), F.skewness("v").alias("_g1"), F.kurtosis("v").alias("_g2"))
    q = ranges.quantiles(x, {"_v": F.col("v"), "_lv": F.col("lv")}, (0.25, 0.5, 0.75, 0.99))
    q = q.select(*[F.get("_v", F.lit(i)).alias(k) for i, k in enumerate(("p25", "p50", "p75", "p99"))], F.get("_lv", F.lit(1)).alias("_lm"))
    n = F.col("n").cast("double")
    one = one.join(F.broadcast(q), F.lit(True)).select("n", "lowest", "_lm", "p25", "p50", "p75", "p99", (F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skew"), ((n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6)).alias("kurtosis"))
    y = x.join(F.broadcast(q), F.lit(True))
    mad = ranges.quantiles(y, {"_mad": F.abs(F.col("v") - F.col("p50")), "_lmad": F.abs(F.col("lv") - F.col("_lm"))}, (0.5,)).select(F.get("_mad", F.lit(0)).alias("_mad"), F.get("_lmad", F.lit(0)).alias("_lmad"))
    tail = y.agg(F.avg((F.col("v") > F.col("p50") + 3 * (F.col("p75") - F.col("p25"))).cast("double")).alias("tail_share"))
    z = one.join(F.broadcast(mad), F.lit(True)).join(F.broadcast(tail), F.lit(True))
    drop = 1 - F.try_divide(F.try_divide("_lmad", "_lm"), F.try_divide("_mad", "p50"))
    z = z.withColumns({"p99_ratio": F.try_divide("p99", "p50"), "dispersion_drop": F.coalesce(drop, F.lit(0.0))})
    rule = (F.col("skew") > 1) | (F.col("kurtosis") > 3) | (F.col("p99_ratio") >= 3) | (F.col("tail_share") > 0.02)
    ok = (F.col("n") >= 30) & (F.col("lowest") >= 0) & rule & (F.col("dispersion_drop") >= 0.2)
    return z.select("n", "skew", "kurtosis", "p99_ratio", "tail_share", "dispersion_drop", F.coalesce(ok, F.lit(False)).alias("advised"))


def scores(df: DataFrame, value: str, first: str, config: Config = Config()) -> DataFrame:
    """One row: the distribution of a score in two groups of entities, their differences, rank test, effect, magnitude and direction."""
    counted = ranks.counted(df, value, first)
    v, also = F.col(value), []
    for i, k in ((1, "_a"), (2, "_b")):
        also += [F.try_divide(F.sum(v * F.col(k)), F.sum(k)).alias(f"mean_{i}")]
        also += [q.alias(f"_{p}_{i}") for p, q in zip(("p25", "median", "p75"), ranges.at_shares(value, k, (0.25, 0.5, 0.75)))]
    x = ranks.from_counts(ranges.running(counted, value, ("_a", "_b")), exact=True, also=tuple(also)).where("n1 >= 3 and n2 >= 3")
    names = [f"{p}_{i}" for i in (1, 2) for p in ("p25", "median", "p75")]
    x = x.withColumns({n: ranges.between(F.col(f"_{n}")) for n in names}).drop(*[f"_{n}" for n in names])
    d = F.when(F.abs("cliffs_delta") < 0.15, "negligible").when(F.col("cliffs_delta") > 0, "higher").otherwise("lower")
    return x.withColumns({"direction": d, "magnitude": F.expr(stats.band_sql("cliffs_delta", config.effect_sizes.cliff, stats.CLIFF_NAMES)), "mean_difference": F.col("mean_1") - F.col("mean_2"), "median_difference": F.col("median_1") - F.col("median_2"), "significant": F.col("p_value") < config.statistics.alpha})


#: Blocks of each side that first enclose a Hodges-Lehmann shift, shifts that a pass counts pairs for, and different pairs that are compared at last at most, but for equal differences.
BLOCKS, SHIFTS, PAIRS = 1024, 48, 2_000_000
#: Different values of the second side that a task of a pass holds at least, where there are so many, and of the first side that meet them in a task, about.
HELD, MET = 4096, 50_000


def hodges_lehmann(df: DataFrame, value: str, first: str) -> DataFrame:
    """One row (shift): the median difference between the groups' values; null if a group is empty.

    Selection in the matrix of differences, whose rows and columns are sorted. Both sides' values are counted and cut into
    ``BLOCKS`` of equal weight; the least and greatest differences of pairs of blocks, weighed on the driver, enclose the
    middle to about two blocks' pairs. While more different pairs are left than ``PAIRS``, a pass counts how many differences
    are at most each of ``SHIFTS`` numbers between. In a pass each value of the first side meets the blocks of the second in
    which these numbers lie from it, one or two as a rule, so its shuffle doesn't grow with the numbers. What is left meets
    in the same way, and its middle is found among counted differences.
    """
    spark = df.sparkSession
    v = df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(first).alias("f"))
    v = v.groupBy("v").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b")).persist()
    try:
        n, m = v.agg(F.sum("a"), F.sum("b")).first()
        if not n or not m:
            return spark.createDataFrame([(None,)], "shift double")
        places = (n * m + 1) // 2, n * m // 2 + 1
        low, high, meeting = _enclosed(v, n, m, *places)
        (below, few), (_, many) = (counts := meeting.at_most([low, high]))[0], counts[1]
        before = None
        while many - few > PAIRS and _ordinal(high) - _ordinal(low) > 1 << 12 and before != (low, high):
            before = low, high
            even = {low + (high - low) * i / (SHIFTS // 2 + 1) for i in range(1, SHIFTS // 2 + 1)}
            cuts = even | {_number(_ordinal(low) + (_ordinal(high) - _ordinal(low)) * i // (SHIFTS // 2 + 1)) for i in range(1, SHIFTS // 2 + 1)}
            cuts = sorted(c for c in cuts if low < c < high)
            for cut, (c, d) in zip(cuts, meeting.at_most(cuts)):
                if c < places[0]:
                    low, below, few = cut, c, d
                elif c >= places[1]:
                    high, many = cut, d
                    break
        near = meeting.between(low, high)
        r = ranges.running(near, "d", ("w",))
        holds = [F.max(F.when((F.col("_before_w") < p - below) & (p - below <= F.col("_before_w") + F.col("w")), F.col("d"))) for p in places]
        return spark.createDataFrame([tuple(r.agg(((holds[0] + holds[1]) / 2).alias("shift")).first())], "shift double")
    finally:
        v.unpersist()


def _enclosed(v: DataFrame, n: int, m: int, first: int, last: int) -> tuple[float, float, _Meeting]:
    """Numbers below and above the differences of two ranks, from the bounds of blocks of equal weight, and how values meet between such numbers."""
    sides = v.select(F.explode(F.array(F.struct(F.lit(True).alias("x"), "v", F.col("a").alias("c")), F.struct(F.lit(False).alias("x"), "v", F.col("b").alias("c")))).alias("s")).select("s.*", F.lit(1).alias("q")).where("c > 0")
    r = ranges.running(sides, "v", ("c", "q"), ("x",))
    cell = lambda k: F.floor(k * F.lit(BLOCKS) / F.col("_all_c"))
    begins = (F.col("_before_c") == 0) | (cell(F.col("_before_c")) < cell(F.col("_before_c") + F.col("c"))) | (F.col("_before_c") + F.col("c") == F.col("_all_c"))
    rows = sorted(map(tuple, r.where(begins).select("x", "v", "_before_c", "_before_q", "_all_q").collect()))
    bounds, sizes = [], []
    for side, size in ((True, n), (False, m)):
        own = [t for t in rows if t[0] == side]
        starts, before = np.array([t[1] for t in own]), np.array([t[2] for t in own] + [size], np.int64)
        bounds.append((starts, np.append(starts[1:], starts[-1]), np.diff(before).astype(float)))
        sizes.append((starts, before, np.array([t[3] for t in own] + [own[0][4]], np.int64)))
    (x0, x1, wx), (y0, y1, wy) = bounds
    least, most, weight = (x0[:, None] - y1[None, :]).ravel(), (x1[:, None] - y0[None, :]).ravel(), (wx[:, None] * wy[None, :]).ravel()
    order, back = np.argsort(least), np.argsort(most)
    slack = 1e-9 * (1 + weight.sum())  # weights are doubles
    low = least[order][np.searchsorted(np.cumsum(weight[order]), first - slack)]
    high = most[back][min(len(back) - 1, np.searchsorted(np.cumsum(weight[back]), last + slack))]
    room = 1e-12 * max(1e-300, np.abs(x0).max(), np.abs(y0).max())
    return float(low - room), float(high + room), _Meeting(v, *sizes)


class _Meeting:
    """The pairs of both sides' counted values whose difference lies near given numbers, block of the second side by block.

    Of each side come the first values of its blocks and, for these and the end, how many rows and different values lie before.
    """

    def __init__(self, v: DataFrame, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray]):
        starts, rows, values = y
        kept = [0]
        for i in range(1, len(starts)):  # a few blocks together while they hold few values
            if values[i] - values[kept[-1]] >= HELD:
                kept.append(i)
        self.v, self.starts, self.x = v, starts[kept], (x[0], x[2])
        ends = [*kept[1:], len(starts)]
        self.after = rows[-1] - rows[ends], values[-1] - values[ends]

    def _pairs(self, low: float, high: float, run, schema: str) -> DataFrame:
        """run(key, x, y) over each block of y and the x from which a number between low and high leads into it; x.whole says that all later blocks lie above."""
        starts, parts = self.starts, int(self.v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # x beyond the number for a block, by the blocks of x: they are dealt to tasks, which have the block's y each
        x0, before = self.x
        first = np.maximum(np.searchsorted(x0, np.append(-np.inf, starts[1:] + low), side="right") - 1, 0)
        last = np.searchsorted(x0, np.append(starts[1:] + high, np.inf), side="right")
        tasks = 1 + (before[last] - before[first]) // MET

        def of_x(batches):
            for part in batches:
                x = part["v"].to_numpy(float)
                begin, end = (np.maximum(np.searchsorted(starts + d, x) - 1, 0) for d in (high, low))
                size = end - begin + 1
                at = np.repeat(np.arange(len(x)), size)
                block = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[at]
                task = (at * 7919 + len(x)) % tasks[block]
                yield part.iloc[at].assign(block=block, task=task, whole=block == end[at])[["block", "task", "v", "a", "whole"]]

        def of_y(batches):
            for part in batches:
                block = np.searchsorted(starts, part["v"].to_numpy(float), side="right") - 1
                size = tasks[block]
                at = np.repeat(np.arange(len(block)), size)
                yield part.iloc[at].assign(block=block[at], task=np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))[["block", "task", "v", "b"]]

        key = ("block", "task")
        xs = self.v.where("a > 0").select("v", "a").mapInPandas(of_x, "block long, task long, v double, a long, whole boolean")
        ys = self.v.where("b > 0").select("v", "b").mapInPandas(of_y, "block long, task long, v double, b long")
        # few bytes but much work: partitions by number, which adaptive execution doesn't put together
        return xs.repartition(parts, *key).groupBy(*key).cogroup(ys.repartition(parts, *key).groupBy(*key)).applyInPandas(run, schema)

    def at_most(self, shifts: list[float]) -> list[tuple[int, int]]:
        """Pairs (x, y) with x <= y + d, and such different pairs, for each d of ascending shifts."""
        after = self.after

        def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            y, v, a, block = y.sort_values("v"), x["v"].to_numpy(float), x["a"].to_numpy(np.int64), int(key[0])
            above = np.append(np.cumsum(y["b"].to_numpy(np.int64)[::-1])[::-1], 0)
            own, whole, out = y["v"].to_numpy(float), x["whole"].to_numpy(bool), []
            for i, d in enumerate(shifts if len(x) else ()):
                at = np.searchsorted(own + d, v)
                out.append((i, int((a * (above[at] + whole * after[0][block])).sum()), int((len(own) - at + whole * after[1][block]).sum())))
            return pd.DataFrame(out, columns=["s", "c", "d"])

        got = self._pairs(shifts[0], shifts[-1], run, "s long, c long, d long").groupBy("s").agg(F.sum("c"), F.sum("d")).collect()
        got = {k: (c, d) for k, c, d in got}
        return [got[i] for i in range(len(shifts))]

    def between(self, low: float, high: float) -> DataFrame:
        """(d, w): differences of pairs with y + low < x <= y + high, and how many pairs have each."""

        def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            y, v = y.sort_values("v"), x["v"].to_numpy(float)
            own, b = y["v"].to_numpy(float), y["b"].to_numpy(np.int64)
            begin = np.searchsorted(own + high, v)
            size = np.searchsorted(own + low, v) - begin
            at = np.repeat(np.arange(len(v)), size)
            other = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[at]
            pairs = pd.DataFrame({"d": v[at] - own[other], "w": x["a"].to_numpy(np.int64)[at] * b[other]})
            return pairs.groupby("d", as_index=False)["w"].sum()

        return self._pairs(low, high, run, "d double, w long").groupBy("d").agg(F.sum("w").alias("w"))


def _ordinal(x: float) -> int:
    """The place of a double among all doubles."""
    i = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return i if i >= 0 else -(i + (1 << 63))


def _number(i: int) -> float:
    return struct.unpack("<d", struct.pack("<q", i))[0] if i >= 0 else -struct.unpack("<d", struct.pack("<q", -i))[0]

"""Monthly series of drivers and vehicles, their baselines and detectors.

Every detector is windows over (entity_type, entity_id, metric) in month order on the
long form of the monthly table, so all of them share one partitioning of a frame that
has a row for each entity, metric and month, not for each transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Config, Temporal
from ..functions import folds, ranges, ranks, stats

KEY = ("entity_type", "entity_id")
SERIES = (*KEY, "metric")
METRICS = ("datetime_count", "no_eld_rate", "non_diesel_rate", "after_hours_rate", "cost_mean", "cost_median", "cost_sum")
#: Metrics that the detectors look at.
TRACKED = METRICS[:5]


def _order():
    return W.partitionBy(*SERIES).orderBy("month")


def _whole():
    return W.partitionBy(*SERIES)


#: Types of entities and the columns of their names.
NAMED = {"driver": "driver_name", "vehicle": "vehicle_id"}


def entities(df: DataFrame, also: tuple[str, ...] = (), types: tuple[str, ...] = tuple(NAMED)) -> DataFrame:
    """Each transaction once for its driver and once for its vehicle, or for one of them; entities without a name or called Unknown are left out."""
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(NAMED[t]).alias("entity_id")) for t in types])).alias("_e")
    x = df.select(*also, "month", "datetime_parsed", "has_eld_activity", "is_diesel_def", "is_business_hours", "transaction_amount", both).select("*", "_e.*").drop("_e")
    return x.where("entity_id is not null and entity_id not in ('', 'Unknown')")


def entity_months(df: DataFrame, also: tuple[str, ...] = (), types: tuple[str, ...] = tuple(NAMED)) -> DataFrame:
    """Seven metrics of each entity's observed months, within each value of ``also``, with the entity's rows (_n) and months (_m).

    The different times of an entity's month are a set, as its amounts are for the median, so one shuffle does.
    """
    rate = lambda c: 100 * F.avg((~F.col(c)).cast("double"))
    g = entities(df, also, types).groupBy(*also, *KEY, "month").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.size(F.collect_set("datetime_parsed")).cast("long").alias("datetime_count"),
        rate("has_eld_activity").alias("no_eld_rate"),
        rate("is_diesel_def").alias("non_diesel_rate"),
        rate("is_business_hours").alias("after_hours_rate"),
        F.avg("transaction_amount").alias("cost_mean"),
        F.median("transaction_amount").alias("cost_median"),
        F.coalesce(F.sum("transaction_amount"), F.lit(0.0)).alias("cost_sum"),
    )
    own = W.partitionBy(*also, *KEY)
    return g.withColumns({"_n": F.sum("_rows").over(own), "_m": F.count("month").over(own)}).where("month is not null").drop("_rows")


def enough(g: DataFrame, least_rows: int = 0, least_months: int = 0) -> DataFrame:
    """Those of ``entity_months`` whose entity has enough rows and months."""
    return g.where((F.col("_n") >= least_rows) & (F.col("_m") >= least_months)).drop("_n", "_m")


def monthly(df: DataFrame, least_rows: int = 0, least_months: int = 0) -> DataFrame:
    """Seven metrics of each entity's observed months, for entities with enough rows and months."""
    return enough(entity_months(df), least_rows, least_months)


def long(m: DataFrame, metrics: tuple[str, ...] = TRACKED) -> DataFrame:
    """(entity_type, entity_id, metric, month, value)."""
    return m.select(*KEY, "month", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("x")).select(*KEY, "x.metric", "month", "x.value")


def series(df: DataFrame, config: Config = Config(), metrics: tuple[str, ...] = TRACKED) -> DataFrame:
    need = config.data_requirements
    return long(monthly(df, need.min_temporal_transactions, need.min_months), metrics)


def baselines(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Distribution of each metric over the peers' entity-months: n and ten statistics for each entity type."""
    return baselines_of(monthly(df, config.data_requirements.min_months, config.data_requirements.min_months))


def baselines_of(months: DataFrame) -> DataFrame:
    """``baselines`` from the peers' monthly table."""
    m = long(months, METRICS)
    qs = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    by = ("entity_type", "metric")
    # equal values are counted and ordered by ranges: entity-months grow with the entities
    r = ranges.running(m.where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c")), "value", ("_c",), by)
    v, c = F.col("value"), F.col("_c")
    n, mean = F.sum(c), F.sum(v * c) / F.sum(c)
    g = r.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), *[q.alias(f"_{k}") for k, q in zip(qs, ranges.at_shares("value", "_c", tuple(qs.values())))])
    sd = m.groupBy(*by).agg(F.stddev_pop("value").alias("std"))
    return g.join(F.broadcast(sd), list(by)).select(*by, "n", "mean", "std", "minimum", "maximum", *[ranges.between(F.col(f"_{k}")).alias(k) for k in qs])  # 14 rows


def against_baseline(s: DataFrame, base: DataFrame) -> DataFrame:
    """Adds z and percentile of each value in its baseline: piecewise linear between the known quantiles, 0 below and 100 above.

    There are two entity types and seven metrics, so the baseline has at most 14 rows and is broadcast.
    """
    x = s.join(F.broadcast(base.drop("n")), ["entity_type", "metric"])
    v = F.col("value")
    points = [("minimum", 0), ("q25", 25), ("median", 50), ("q75", 75), ("q90", 90), ("q95", 95), ("q99", 99), ("maximum", 100)]
    pct = F.when(v <= F.col("minimum"), 0.0)
    for (a, pa), (b, pb) in zip(points, points[1:]):
        pct = pct.when(v <= F.col(b), pa + F.coalesce(F.try_divide(v - F.col(a), F.col(b) - F.col(a)), F.lit(0.0)) * (pb - pa))
    z = F.when(F.col("std") == 0, 0.0).otherwise((v - F.col("mean")) / F.col("std"))
    return x.withColumns({"z": z, "percentile": pct.otherwise(100.0)}).select(*SERIES, "month", "value", "z", "percentile")


def changes(s: DataFrame) -> DataFrame:
    """Adds change, the score against the month before: 0 from 0 to 0, the value from 0, else the relative change; null at the start."""
    a, b = F.lag("value").over(_order()), F.col("value")
    return s.withColumn("change", F.when(a.isNull(), None).when((a == 0) & (b == 0), 0.0).when(a == 0, b).when(b == 0, -a).otherwise((b - a) / a))


def spikes(s: DataFrame, base: DataFrame, t: Temporal = Temporal(), least_months: int = 3) -> DataFrame:
    """(series, spike_months, highest_percentile) of rises by more than ``spike_change`` or beyond the baseline's 95th percentile."""
    x = changes(s).withColumn("_n", F.count(F.lit(1)).over(_whole())).join(F.broadcast(base.select("entity_type", "metric", "mean", "std")), ["entity_type", "metric"])
    x = x.where((F.col("_n") >= least_months) & (F.col("std") > 0)).withColumn("_z", (F.col("value") - F.col("mean")) / F.col("std"))
    x = x.where((F.col("change") > 0) & ((F.col("change") > t.spike_change) | (F.col("_z") > t.spike_z)))
    return x.groupBy(*SERIES).agg(F.array_join(F.array_sort(F.collect_list("month")), ",").alias("spike_months"), F.max(F.expr(stats.normal_cdf_sql("_z")) * 100).alias("highest_percentile"))


def escalations(s: DataFrame, t: Temporal = Temporal()) -> DataFrame:
    """(series, longest): the longest run of rises, where it has ``escalation_months`` or more."""
    x = changes(s).where("change is not null").withColumn("_up", F.col("change") > 0)
    x = x.withColumn("_island", F.sum((~F.col("_up")).cast("int")).over(_order()))
    runs = x.where("_up").groupBy(*SERIES, "_island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(*SERIES).agg(F.max("run").alias("longest")).where(F.col("longest") >= t.escalation_months)


def volatility(s: DataFrame, t: Temporal = Temporal()) -> DataFrame:
    """(entity, volatility): deviations of the changes below ``volatility_cap``, added up over metrics."""
    x = changes(s).where("change is not null")
    per = x.groupBy(*SERIES).agg(F.coalesce(F.stddev_samp(F.when(F.abs("change") < t.volatility_cap, F.col("change"))), F.lit(0.0)).alias("v"))
    return per.groupBy(*KEY).agg(F.sum("v").alias("volatility"))


def rolling_outliers(s: DataFrame, t: Temporal = Temporal(), exclusive: bool = False) -> DataFrame:
    """Months further than ``rolling_z`` deviations from their window's mean.

    With the month itself in a window of three this cannot be (at most 2 / sqrt 3); ``exclusive`` takes the months before.
    Rates of few rows often lie exactly at the limit, where the last bit of the deviation decides: it is folded as in SQL.
    """
    w = _order().rowsBetween(-t.rolling_window, -1) if exclusive else _order().rowsBetween(1 - t.rolling_window, 0)
    x = s.withColumns({"_m": F.avg("value").over(w), "_s": folds.deviation(F.collect_list("value").over(w))})
    x = x.withColumn("z", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")))
    return x.where(F.abs("z") > t.rolling_z).select(*SERIES, "month", "value", "z")


def autocorrelation(s: DataFrame, t: Temporal = Temporal()) -> DataFrame:
    """(series, n, acf1, risk_level) of series that are long enough and not constant."""
    x = s.withColumns({"_d": F.col("value") - F.avg("value").over(_whole())})
    x = x.withColumn("_next", F.lead("_d").over(_order()))
    g = x.groupBy(*SERIES).agg(F.count("value").alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.try_divide(F.sum(F.col("_d") * F.col("_next")), F.sum(F.col("_d") * F.col("_d"))).alias("acf1"))
    g = g.where((F.col("n") >= t.acf_min) & (F.col("_lo") < F.col("_hi")))
    return g.select(*SERIES, "n", "acf1", F.when(F.col("acf1") > t.acf_high, "HIGH").when(F.col("acf1") > t.acf_medium, "MEDIUM").otherwise("LOW").alias("risk_level"))


def fraud_patterns(m: DataFrame, t: Temporal = Temporal(), *also: Column) -> DataFrame:
    """(entity, off_hours_concentration, spike_and_retreat, escalation_by_halves, operational_anomaly) from the monthly table; ``also`` are further aggregates."""
    own, order = W.partitionBy(*KEY), W.partitionBy(*KEY).orderBy("month")
    x = m.withColumns({"_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(own)})

    def retreat(c):
        a, b, d = F.col(c), F.lead(c, 1).over(order), F.lead(c, 2).over(order)
        return F.coalesce((b > t.spike_factor * a) & (d < t.retreat_factor * b), F.lit(False))

    x = x.withColumns({"_sr": retreat("datetime_count") | retreat("no_eld_rate")})
    half = F.floor(F.col("_n") / 2)
    first, second = F.avg(F.when(F.col("_r") <= half, F.col("no_eld_rate"))), F.avg(F.when(F.col("_r") > half, F.col("no_eld_rate")))
    return x.groupBy(*KEY).agg(
        F.coalesce(F.avg(F.when(F.col("_r") > F.col("_n") - 3, F.col("after_hours_rate"))) > t.off_hours, F.lit(False)).alias("off_hours_concentration"),
        F.bool_or("_sr").alias("spike_and_retreat"),
        F.coalesce((F.max("_n") >= t.halves_months) & (second > t.halves_factor * first), F.lit(False)).alias("escalation_by_halves"),
        F.lit(False).alias("operational_anomaly"),
        *also,
    )


def latest(m: DataFrame) -> DataFrame:
    """The last observed month of each entity."""
    return m.groupBy(*KEY).agg(F.max(F.struct("month", *METRICS)).alias("_l")).select(*KEY, "_l.*")


def _kendall(n: Column, s: Column, ties: Column, alpha: float = 0.05) -> list[tuple[str, Column]]:
    """Columns of the test from a series' length, S and ties, each to be selected over those before it."""
    size, var = n.cast("double"), F.col("_var")
    p = F.col("p_value") < alpha
    trend = F.when(n < 3, "insufficient_data").when(var <= 0, "no_trend").when(p & (s > 0), "increasing").when(p & (s < 0), "decreasing").otherwise("no_trend")
    return [
        ("_var", (size * (size - 1) * (2 * size + 5) - ties) / 18),
        ("tau", F.try_divide(s, size * (size - 1) / 2)),
        ("z", F.when((n >= 3) & (var > 0), (s - F.signum(s)) / F.sqrt(var))),
        ("p_value", F.expr(stats.two_sided_p_sql("z"))),
        ("trend", trend),
    ]


def mann_kendall(s: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(series, n, s, tau, z, p_value, trend); a series is an array of its months, within which pairs are counted."""
    v, _ = folds.ordered("month", "value")
    x = s.groupBy(*SERIES).agg(v.alias("_v")).withColumn("n", F.size("_v").cast("long"))
    x = x.withColumns({"s": folds.kendall_s(F.col("_v")), "_ties": folds.ties(F.col("_v"))})
    for name, column in _kendall(F.col("n"), F.col("s"), F.col("_ties"), alpha):
        x = x.withColumn(name, column)
    return x.select(*SERIES, "n", "s", "tau", "z", "p_value", "trend")


def cusum(s: DataFrame, k: float = 0.5, h: float = 4.5) -> DataFrame:
    """(series, change_month, direction): the first month at which a cumulative sum passes h. The folds are running sums less their running extremes."""
    x = s.withColumns({"_m": F.avg("value").over(_whole()), "_s": F.stddev_samp("value").over(_whole()), "_i": F.row_number().over(_order())})
    x = x.where((F.col("_s") > 0) & (F.col("_i") > 1)).withColumn("_z", (F.col("value") - F.col("_m")) / F.col("_s"))
    run = _order().rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"_up": F.sum(F.col("_z") - k).over(run), "_down": F.sum(F.col("_z") + k).over(run)})
    x = x.withColumns({"_cp": F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(run)), "_cm": F.col("_down") - F.greatest(F.lit(0.0), F.max("_down").over(run))})
    x = x.where((F.col("_cp") > h) | (F.col("_cm") < -h))
    return x.groupBy(*SERIES).agg(F.min(F.struct("month", F.when(F.col("_cp") > h, "increase").otherwise("decrease").alias("d"))).alias("f")).select(*SERIES, F.col("f.month").alias("change_month"), F.col("f.d").alias("direction"))


def halves(s: DataFrame, least: int = 3, last: int | None = None) -> DataFrame:
    """Later half of each series, or of its ``last`` months, against the earlier half: rank test, effect and direction by the medians."""
    if last is not None:
        latest_first = W.partitionBy(*SERIES).orderBy(F.desc("month"))
        s = s.withColumn("_back", F.row_number().over(latest_first)).where(F.col("_back") <= last).drop("_back")
    x = s.withColumns({"_r": F.row_number().over(_order()), "_n": F.count(F.lit(1)).over(_whole())}).withColumn("later", F.col("_r") > F.floor(F.col("_n") / 2))
    x = x.where(F.floor(F.col("_n") / 2) >= least)
    t = ranks.rank_test(x, "value", "later", SERIES, exact=True, ranged=False)
    med = x.groupBy(*SERIES).agg(F.percentile(F.when(~F.col("later"), F.col("value")), F.lit(0.5)).alias("median_early"), F.percentile(F.when(F.col("later"), F.col("value")), F.lit(0.5)).alias("median_late"))
    d = F.when(F.coalesce(F.col("p_value") >= 0.05, F.lit(True)), "stable").when(F.col("median_late") > F.col("median_early"), "higher").when(F.col("median_late") < F.col("median_early"), "lower").otherwise("stable")
    return t.join(med, list(SERIES)).withColumn("direction", d)


def score(df: DataFrame, peers: DataFrame, config: Config = Config()) -> DataFrame:
    """The temporal risk score of each entity of df, with baselines from peers, and the counts it is made of."""
    need = config.data_requirements
    return score_of(monthly(df, need.min_temporal_transactions, need.min_months), monthly(peers, need.min_months, need.min_months), config)


def branch_months(df: DataFrame, config: Config = Config(), types: tuple[str, ...] = tuple(NAMED)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Monthly tables of the asked types of entities in enriched transactions from one pass: the target's, the peers' for baselines, and those of peers with enough rows for a score.

    The pass is kept until the session ends: every detector reads it.
    """
    need = config.data_requirements
    g = entity_months(df, ("is_target",), types).persist()
    mine, others = g.where("is_target").drop("is_target"), g.where("not is_target").drop("is_target")
    return enough(mine, need.min_temporal_transactions, need.min_months), enough(others, need.min_months, need.min_months), enough(others, need.min_temporal_transactions, need.min_months)


#: Metrics whose changes, escalations and outliers count for the score, in the order of reports; persistence counts for rates.
BEHAVIOURAL = ("no_eld_rate", "non_diesel_rate", "after_hours_rate", "datetime_count")
RATES = BEHAVIOURAL[:3]
#: Metrics as reports call them.
NAMES = {"datetime_count": "Transaction Volume", "no_eld_rate": "No ELD Rate", "non_diesel_rate": "Non-Diesel Rate", "after_hours_rate": "After Hours Rate", "cost_mean": "Average Transaction Cost"}
#: Texts of patterns and of the falling cost (fixed values).
PATTERNS = {
    "off_hours_concentration": "OFF-HOURS CONCENTRATION PATTERN (excessive non-business hour activity)",
    "spike_and_retreat": "SPIKE-AND-RETREAT PATTERN (rapid escalation followed by sudden cessation)",
    "escalation_by_halves": "GRADUAL ESCALATION PATTERN (sustained increase over extended period)",
    "operational_anomaly": "OPERATIONAL ANOMALY PATTERN (behavior inconsistent with business patterns)",
}
FALLING_COST = "DECREASING average cost (potential passenger vehicle use)"


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def findings(m: DataFrame, peer_months: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each entity and metric with what every detector finds in the series, from one shuffle of the long table.

    (series, n, s, tau, z, p_value, trend, change (month, direction), change_points, spike_months, spike_percentile, escalation,
    volatility, outlier_months, acf1, risk_level). All windows are over the series in month order, and the grouping by series needs
    no further shuffle. Spikes, escalations, volatility and outliers are those of ``BEHAVIOURAL`` metrics, persistence that of ``RATES``.
    """
    t, need = config.temporal, config.data_requirements
    base = baselines_of(peer_months).select("entity_type", "metric", F.col("mean").alias("_bm"), F.col("std").alias("_bs"))
    # few bytes but much work: partitions by number, which adaptive execution doesn't put together
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = changes(long(m).repartition(parts, *SERIES)).join(F.broadcast(base), ["entity_type", "metric"], "left")  # 14 rows
    near, upto = _order().rowsBetween(1 - t.rolling_window, 0), _order().rowsBetween(W.unboundedPreceding, 0)
    v, i = F.col("value"), F.col("_i")
    x = x.withColumns({"_i": F.row_number().over(_order()), "_n": F.count(F.lit(1)).over(_whole()), "_mean": F.avg(v).over(_whole()), "_sd": F.stddev_samp(v).over(_whole()), "_next": F.lead(v).over(_order())})
    x = x.withColumns({"_rm": F.avg(v).over(near), "_rs": F.stddev_samp(v).over(near), "_rn": F.count(v).over(near)})
    own = F.when((F.col("_sd") > 0) & (i > 1), (v - F.col("_mean")) / F.col("_sd"))
    stopped = F.max(F.when(~(F.col("change") > 0), i)).over(upto)  # the last month without a rise
    x = x.withColumns({"_z": own, "_bz": F.when(F.col("_bs") > 0, (v - F.col("_bm")) / F.col("_bs")), "_rz": F.when((F.col("_rn") >= 2) & (F.col("_rs") > 0), (v - F.col("_rm")) / F.col("_rs")), "_stop": stopped})
    x = x.withColumns({"_up": F.sum(F.col("_z") - t.cusum_k).over(upto), "_down": F.sum(F.col("_z") + t.cusum_k).over(upto)})
    x = x.withColumns({"_cp": F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(upto)), "_cm": F.col("_down") - F.greatest(F.lit(0.0), F.max("_down").over(upto))})
    rises, d, dn = F.col("change") > 0, v - F.col("_mean"), F.col("_next") - F.col("_mean")
    behaviour = F.col("metric").isin(*BEHAVIOURAL)
    # without a spread in the baseline, or too short, a metric has no month-over-month findings
    compared = behaviour & (F.col("_n") >= need.min_months) & (F.col("_bs") > 0)
    spiked = compared & rises & ((F.col("change") > t.spike_change) | (F.col("_bz") > t.spike_z))
    passed = F.when(F.col("_cp") > t.cusum_h, "increase").when(F.col("_cm") < -t.cusum_h, "decrease")
    values, keys = folds.ordered("month", "value")
    months = lambda hit: F.array_sort(F.collect_list(F.when(hit, F.col("month"))))
    g = x.groupBy(*SERIES).agg(
        values.alias("_v"), keys.alias("_k"),
        F.min(F.when(passed.isNotNull(), F.struct("month", passed.alias("direction")))).alias("change"),
        months(spiked).alias("spike_months"), F.max(F.when(spiked, F.col("_bz"))).alias("_spike_z"),
        F.max(F.when(compared & rises, i - F.coalesce("_stop", F.lit(1)))).alias("_run"),
        F.stddev_samp(F.when(compared & (F.abs("change") < t.volatility_cap), F.col("change"))).alias("_volatile"),
        months(behaviour & (F.abs("_rz") > t.rolling_z)).alias("outlier_months"),
        F.when(F.first("metric").isin(*RATES) & (F.count(v) >= t.acf_min) & (F.min(v) < F.max(v)), F.try_divide(F.sum(d * dn), F.sum(d * d))).alias("acf1"),
    )
    g = g.withColumn("_pairs", folds.measured(F.col("_v")))
    g = g.withColumns({
        "n": F.size("_v").cast("long"), "s": F.col("_pairs.s"), "_ties": F.col("_pairs.ties"),
        "change_points": F.coalesce(folds.change_points(F.col("_v"), F.col("_k"), found=F.col("_pairs.breaks")), F.array().cast("array<string>")),
        "spike_percentile": F.when(F.size("spike_months") > 0, F.expr(stats.normal_cdf_sql("_spike_z")) * 100),
        "escalation": F.when(F.col("_run") >= t.escalation_months, F.col("_run")), "volatility": F.coalesce("_volatile", F.lit(0.0)),
        "risk_level": F.when(F.col("acf1") > t.acf_high, "HIGH").when(F.col("acf1") > t.acf_medium, "MEDIUM").when(F.col("acf1").isNotNull(), "LOW"),
    })
    for name, column in _kendall(F.col("n"), F.col("s"), F.col("_ties")):
        g = g.withColumn(name, column)
    return g.drop("_v", "_k", "_spike_z", "_run", "_volatile", "_ties", "_var", "_pairs")


def _indicators(f: DataFrame) -> DataFrame:
    """``findings`` with adverse (the trend is of concern) and texts, its indicators as (kind, rank, text) in the order of reports."""
    metric = F.col("metric")
    name = F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), metric)
    first, then = (F.array_position(F.array(*map(F.lit, order)), metric).cast("int") for order in (TRACKED, BEHAVIOURAL))
    # for costs the decrease is of concern: small vehicles
    adverse = F.when(metric == "cost_mean", F.col("trend") == "decreasing").otherwise(F.col("trend") == "increasing")
    texts = [
        (first, F.when(adverse, F.when(metric == "cost_mean", FALLING_COST).otherwise(F.concat(F.lit("INCREASING "), name)))),
        (then, F.when(F.size("spike_months") > 0, F.concat(F.lit("SUDDEN SPIKE in "), name, F.lit(" (+"), _fixed(F.col("spike_percentile"), 0), F.lit("th percentile)")))),
        (then, F.when(F.col("escalation").isNotNull(), F.concat(F.lit("GRADUAL ESCALATION in "), name, F.lit(" ("), F.col("escalation").cast("string"), F.lit(" consecutive months)")))),
        (then, F.when(F.size("outlier_months") > 0, F.concat(F.lit("ANOMALOUS MONTHS in "), name, F.lit(": "), F.array_join("outlier_months", ", ")))),
        (then, F.when(F.col("risk_level") == "HIGH", F.concat(F.lit("PERSISTENT PATTERN in "), name, F.lit(" (autocorr="), _fixed(F.col("acf1"), 2), F.lit(")")))),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), rank.alias("rank"), text.alias("text")) for k, (rank, text) in enumerate(texts)])
    return f.withColumns({"adverse": adverse, "texts": F.filter(rows, lambda r: r["text"].isNotNull())})


def analysis(m: DataFrame, peer_months: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each entity: its findings of all metrics, indicators in words, current factors and the temporal risk score.

    metrics is a map from metric to what ``findings`` has for it, indicators and current_factors are arrays of texts in
    the order of reports. The series' findings are grouped once by entity and meet the entity's patterns and latest month
    in one join; both sides are a row for each entity and metric, or less.
    """
    t, th = config.temporal, config.thresholds
    f = _indicators(findings(m, peer_months, config))
    kept = F.struct(*[c for c in f.columns if c not in (*SERIES, "adverse", "texts")])
    e = f.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("metric"), kept))).alias("metrics"), F.array_sort(F.flatten(F.collect_list("texts"))).alias("_texts"),
        F.count_if("adverse").alias("trends"), F.count("change").alias("changes"), F.sum(F.size("change_points")).cast("long").alias("points"), F.count_if(F.size("spike_months") > 0).alias("spikes"),
        F.count("escalation").alias("escalations"), F.count_if(F.col("risk_level") == "HIGH").alias("persistent"), F.sum(F.size("outlier_months")).cast("long").alias("outliers"), F.sum("volatility").alias("volatility"),
    )
    x = fraud_patterns(m, t, F.max(F.struct("month", *METRICS)).alias("_now")).join(e, list(KEY))
    flags = [F.col(c) for c in PATTERNS]
    found = F.filter(F.array(*[F.when(F.col(c), text) for c, text in PATTERNS.items()]), lambda y: y.isNotNull())
    x = x.withColumns({"indicators": F.concat(F.transform("_texts", lambda y: y["text"]), found), "patterns": sum((c.cast("int") for c in flags), F.lit(0)), "latest_month": F.col("_now.month")})
    limits = (("no_eld_rate", th.high_no_eld, 8), ("non_diesel_rate", th.high_non_diesel, 6), ("after_hours_rate", th.high_after_hours, 6))
    high = [(F.col(f"_now.{c}") > 100 * most, F.concat(F.lit(f"High {NAMES[c]} ("), _fixed(F.col(f"_now.{c}"), 1), F.lit("%)")), w) for c, most, w in limits]
    x = x.withColumns({"current": sum((F.when(c, w).otherwise(0) for c, _, w in high), F.lit(0)), "current_factors": F.filter(F.array(*[F.when(c, text) for c, text, _ in high]), lambda y: y.isNotNull())})
    cap = lambda c, w, most: F.least(F.lit(most), c * w)
    parts = (("trends", 10, 20), ("spikes", 12, 25), ("escalations", 8, 15), ("patterns", 15, 30), ("persistent", 8, 15), ("outliers", 5, 15))
    whole = sum((cap(F.col(c), w, most) for c, w, most in parts), cap(F.col("changes") + F.col("points"), 8, 25) + F.col("current"))
    x = x.withColumn("temporal_risk_score", F.least(F.lit(100), whole).cast("long")).withColumn("risk_band", F.expr(stats.risk_band_sql("temporal_risk_score", th.bands)))
    return x.drop("_texts", "_now")


def score_of(m: DataFrame, peer_months: DataFrame, config: Config = Config()) -> DataFrame:
    """``score`` from monthly tables."""
    names = ("trends", "changes", "points", "spikes", "escalations", "persistent", "outliers", "patterns")
    return analysis(m, peer_months, config).select(*KEY, "latest_month", *names, "current", "temporal_risk_score", "risk_band")


def indicators(m: DataFrame, peer_months: DataFrame, config: Config = Config()) -> DataFrame:
    """(entity, indicators, current_factors, total_risk_factors, total_change_points, has_fraud_patterns, volatility, recent_behavior) of each entity."""
    x = analysis(m, peer_months, config)
    return x.select(*KEY, "indicators", "current_factors", F.size("indicators").alias("total_risk_factors"), (F.col("changes") + F.col("points")).alias("total_change_points"), (F.col("patterns") > 0).alias("has_fraud_patterns"), "volatility", F.size("current_factors").alias("recent_behavior"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Counts and central scores overall (entity_type null) and for each type, in one pass."""
    return scores.rollup("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.avg("temporal_risk_score").alias("mean_score"), F.percentile("temporal_risk_score", F.lit(0.5)).alias("median_score"), F.count_if(F.col("risk_band") == "critical").alias("critical"), F.count_if(F.col("risk_band") == "high").alias("high"), F.count_if(F.col("spikes") > 0).alias("with_spikes"), F.count_if(F.col("changes") > 0).alias("with_changes"), F.count_if(F.col("patterns") > 0).alias("with_patterns"))


def timeline(changes_found: DataFrame) -> DataFrame:
    """(month, changes, is_peak) of first change points."""
    g = changes_found.groupBy(F.col("change_month").alias("month")).agg(F.count(F.lit(1)).alias("changes"))
    return g.withColumn("is_peak", F.rank().over(W.orderBy(F.desc("changes"))) == 1)


def timeline_summary(t: DataFrame) -> DataFrame:
    """One row: months, total, shares of the first and last third of the months, clustered (variance of the monthly counts above their mean)."""
    third = F.ntile(3).over(W.orderBy("month"))  # a row for each month
    t = t.withColumn("_third", third)
    share = lambda k: F.coalesce(F.try_divide(F.sum(F.when(F.col("_third") == k, F.col("changes"))), F.sum("changes")), F.lit(0.0))
    return t.agg(share(1).alias("early_share"), share(3).alias("late_share"), F.count(F.lit(1)).alias("months"), F.coalesce(F.sum("changes"), F.lit(0)).alias("total"), F.coalesce(F.var_samp("changes") > F.avg("changes"), F.lit(False)).alias("clustered"))

import math
import time
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import config, dashboard, report
from ledgerlens.functions import ranges, ranks, stats, workers
from ledgerlens.operators import clean, compare, features, patterns, quality, risk, split, temporal
from ledgerlens.plans import analyse
from ledgerlens.schema import REQUIRED, TYPES
from ledgerlens.sources import readers

DDL = ", ".join(f"{c} {TYPES[c]}" for c in REQUIRED)


def row(**over):
    x = {c: {"string": "x", "double": 10.0, "bigint": 1, "timestamp_ntz": datetime(2024, 1, 1, 12)}[TYPES[c]] for c in REQUIRED}
    return tuple((x | over)[c] for c in REQUIRED)


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([row(**r) for r in rows], DDL)


def test_settings():
    assert config.from_yaml_string("target: {location: 3}").target.location == 3
    assert config.from_yaml_string("thresholds: {risk_thresholds: [80, 60, 30]}").thresholds.bands == (80, 60, 30)
    for bad in ("- a", "", "target: {location: -1}", "nope: 1", "a: [", "risk_weights: {cost: 0.5}", "business_hours: {start_hour: 5, end_hour: 5}", "sources: {fuel: a.csv}", "performance: {n_bootstrap: 10}"):
        with pytest.raises(config.ConfigError):
            config.from_yaml_string(bad)
    with pytest.raises(FileNotFoundError):
        config.from_yaml("/nowhere.yaml")


def test_wilson_grid(spark):
    # score intervals; figures like 0 to 0.308 for 0 of 10 belong to the exact binomial interval
    grid = [(0, 10, 0.0, 0.2775), (10, 10, 0.7225, 1.0), (5, 10, 0.2366, 0.7634), (50, 100, 0.4038, 0.5962), (1, 20, 0.0089, 0.2361), (19, 20, 0.7639, 0.9911)]
    low, high = stats.wilson_sql("k", "n")
    got = spark.createDataFrame([(k, n) for k, n, *_ in grid] + [(0, 0)], "k long, n long").select("k", F.expr(low).alias("lo"), F.expr(high).alias("hi")).collect()
    for g, (_, _, a, b) in zip(got, grid):
        assert abs(g.lo - a) < 1e-4 and abs(g.hi - b) < 1e-4
    assert got[-1].lo is None and got[-1].hi is None


def test_two_by_two(spark):
    cells = [(15, 100, 8, 100), (0, 10, 5, 10), (0, 10, 0, 10), (10, 10, 10, 10), (3, 0, 1, 5)]
    got = spark.createDataFrame(cells, "a long, n1 long, b long, n2 long")
    got = compare.proportions(got).collect()
    r = got[0]
    z = (0.15 - 0.08) / math.sqrt(0.115 * 0.885 * 0.02)
    assert abs(r.z - z) < 1e-9 and abs(r.p_value - math.erfc(z / math.sqrt(2))) < 1e-6
    assert abs(r.risk_ratio - 1.875) < 1e-9 and abs(r.odds_ratio - 15 * 92 / (8 * 85)) < 1e-9
    assert r.risk_ratio_low < r.risk_ratio < r.risk_ratio_high and 0 <= r.cramers_v <= 1
    assert got[1].risk_ratio > 0 and got[2].p_value == 1 and got[3].p_value == 1 and got[4].p_value is None


def test_erfc_polynomial(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(stats.erfc_sql("x")).alias("y")).collect()
    for x, g in zip(xs, got):
        assert abs(g.y - math.erfc(x)) < 2e-7


def test_ranks_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 8, 30).astype(float), rng.integers(2, 11, 25).astype(float)
    df = spark.createDataFrame([(x, True) for x in a.tolist()] + [(x, False) for x in b.tolist()] + [(None, True)], "v double, first boolean")
    r = ranks.rank_test(df, "v", "first").first()
    delta = np.sign(a[:, None] - b[None, :]).mean()
    assert abs(r.cliffs_delta - delta) < 1e-12 and (r.n1, r.n2) == (30, 25)
    assert abs(r.u - ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum())) < 1e-9 and 0 <= r.p_value <= 1
    few = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, True), (4.0, False), (5.0, False), (6.0, False)], "v double, first boolean")
    assert abs(ranks.rank_test(few, "v", "first", exact=True).first().p_value - 0.1) < 1e-12
    d = ranks.cohens_d(df, "v", "first").first()
    pooled = math.sqrt((29 * a.var(ddof=1) + 24 * b.var(ddof=1)) / 53)
    assert abs(d.cohens_d - (a.mean() - b.mean()) / pooled) < 1e-9
    shift = compare.hodges_lehmann(df, "v", "first").first().shift
    assert abs(shift - np.median(a[:, None] - b[None, :])) < 1e-9


def test_benjamini_hochberg(spark):
    ps = [0.001, 0.008, 0.04, 0.05, 0.3, None]
    got = {r.p_value: r for r in ranks.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p_value double")).collect()}
    assert got[0.001].rejected and got[0.008].rejected and not got[0.04].rejected and not got[None].rejected
    assert all(r.q_value >= (p or 1) - 1e-12 for p, r in got.items()) and abs(got[0.001].q_value - 0.006) < 1e-12


def test_workers(spark):
    assert abs(workers.fisher_exact(8, 2, 1, 5) - 0.03496503) < 1e-6
    assert workers.fisher_exact(0, 0, 0, 0) != workers.fisher_exact(0, 0, 0, 0)
    df = spark.createDataFrame([(float(x), float(x % 7), float(3 * x)) for x in range(1, 60)], "a double, b double, c double")
    low, high = workers.bootstrap(df, "a", 500).first()
    assert low < 30 < high and (low, high) == tuple(workers.bootstrap(df, "a", 500).first())
    assert tuple(workers.bootstrap(df.limit(0), "a", 500).first()) == (None, None)
    got = {r.feature: r.vif for r in workers.vif(df, ["a", "b"]).collect()}
    x = np.array([[v, v % 7] for v in range(1, 60)], float)
    want = np.diag(x.T @ x) * np.diag(np.linalg.inv(x.T @ x))
    np.testing.assert_allclose([got["a"], got["b"]], want)
    with pytest.raises(ValueError):
        workers.vif(df, ["a", "nope"])


@pytest.mark.parametrize("block", [20_000, 40])
def test_bootstrap_interval_is_that_of_the_mean(spark, monkeypatch, block):
    """Percentiles of many resampled means lie where the normal approximation puts them, however the values are dealt."""
    monkeypatch.setattr(workers, "BLOCK", block)
    x = np.random.default_rng(2).gamma(2.0, 50.0, 900).round(1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    low, high = workers.bootstrap(df, "v", 4_000).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert abs(low - (x.mean() - half)) < 0.15 * half and abs(high - (x.mean() + half)) < 0.15 * half


@pytest.mark.parametrize("block", [20_000, 40])
def test_bootstrap_of_other_statistics(spark, monkeypatch, block):
    """Against numpy's resamples of the same rows."""
    monkeypatch.setattr(workers, "BLOCK", block)
    rng = np.random.default_rng(4)
    x, y = rng.gamma(2.0, 50.0, 400).round(1), rng.gamma(3.0, 5.0, 400).round(1) + 1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "v double, w double")
    draws = rng.integers(0, 400, (4000, 400))
    trimmed = lambda a: np.sort(a, axis=1)[:, 40:-40].mean(axis=1)
    asked = {"median": (workers.quantile(0.5), None, np.median(x[draws], axis=1)), "p90": (workers.quantile(0.9), None, np.quantile(x[draws], 0.9, axis=1)), "trimmed": (workers.trimmed_mean(0.1), None, trimmed(x[draws])), "ratio": (workers.ratio(), "w", x[draws].sum(axis=1) / y[draws].sum(axis=1))}
    for name, (f, other, want) in asked.items():
        got = workers.bootstrap(df, "v", 2_000, statistic=f, other=other).first()
        low, high = np.quantile(want, [0.025, 0.975])
        assert abs(got.low - low) < 0.15 * (high - low) and abs(got.high - high) < 0.15 * (high - low), name
    assert tuple(workers.bootstrap(df.limit(0), "v", 500, statistic=workers.quantile(0.5)).first()) == (None, None)


def test_ranges_rise_with_values(spark):
    xs = [-1e300, -5.0, -1.0001, -1.0, -1e-70, -0.0, 0.0, 1e-70, 0.3, 1.0, 1.5, 3.0, 1e9, 1e300, float("inf"), float("nan")]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", ranges.range_of(F.col("x")).alias("r")).orderBy("i").collect()]
    assert got == sorted(got) and got[5] == got[6] and got[2] != got[10]
    v = np.random.default_rng(3).normal(size=501).round(2)
    q = ranges.quantiles(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), {"a": F.col("v"), "b": 2 * F.col("v")}, (0.0, 0.25, 0.5, 0.99, 1.0)).first()
    np.testing.assert_allclose(q.a, np.quantile(v, (0, 0.25, 0.5, 0.99, 1)))
    np.testing.assert_allclose(q.b, 2 * np.array(q.a))


def test_hodges_lehmann_forms_no_pairs(spark):
    rng = np.random.default_rng(5)
    for n, m in ((7, 6), (12, 11)):
        a, b = rng.normal(size=n), np.r_[rng.normal(2, 3, m - 1), 0.0]
        df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True), (9.0, None)], "v double, first boolean")
        assert abs(compare.hodges_lehmann(df, "v", "first").first().shift - np.median(a[:, None] - b[None, :])) < 1e-9
    assert compare.hodges_lehmann(df.where("first"), "v", "first").first().shift is None


@pytest.mark.parametrize("kind", ["smooth", "cents", "two", "tails", "one"])
def test_hodges_lehmann_narrows_by_passes(spark, monkeypatch, kind):
    """Few blocks and pairs, so that passes count: smooth values, many ties, two clusters, tails over many powers of ten."""
    monkeypatch.setattr(compare, "BLOCKS", 4)
    monkeypatch.setattr(compare, "PAIRS", 10)
    rng = np.random.default_rng(7)
    draw = {"smooth": lambda k: rng.normal(size=k), "cents": lambda k: rng.integers(0, 90, k) / 100, "two": lambda k: rng.integers(0, 2, k) * 50.0, "tails": lambda k: np.exp(rng.normal(0, 20, k)), "one": lambda k: np.full(k, 3.0)}[kind]
    a, b = draw(101), draw(80)
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "v double, first boolean")
    want = np.median(a[:, None] - b[None, :])
    assert abs(compare.hodges_lehmann(df, "v", "first").first().shift - want) <= 1e-9 * max(1, abs(want))


def test_report_and_dashboard(spark):
    df = split.in_period(analyse.transactions(spark, "/root/testdata/sf0.001")).persist()
    text = report.report(df, config.Config(performance=config.Performance(n_bootstrap=500)))
    for title in ("SCOPE", "PERIOD", "SLICES", "METHODOLOGY", "DATA QUALITY", "TEST: NO ELD MATCH", "TEST: COST DISTRIBUTION", "TESTS, FALSE-DISCOVERY RATE", "FINANCIAL IMPACT", "CHANGE POINTS", "DRIVER RISK", "VEHICLE RISK", "TEMPORAL RISK", "SUMMARY"):
        assert f"\n{title}\n" in text, title
    rows = dashboard.panels(df)
    assert len(rows["Significance (-log10 p)"]) == 5 and len(rows["Spend by month"]) > 3


def plain_fisher(a, b, c, d):
    n1, n2, k = a + b, c + d, a + c
    ways = {x: math.comb(n1, x) * math.comb(n2, k - x) for x in range(max(0, k - n2), min(k, n1) + 1)}
    return float(Fraction(sum(w for w in ways.values() if w <= ways[a]), math.comb(n1 + n2, k)))


def test_fisher_on_real_counts(spark):
    rng = np.random.default_rng(9)
    for most in (1, 4, 30, 400):
        for a, b, c, d in rng.integers(0, most + 1, (60, 4)).tolist():
            if a + b + c + d:
                assert abs(workers.fisher_exact(a, b, c, d) - plain_fisher(a, b, c, d)) < 1e-9, (a, b, c, d)
    began = time.perf_counter()
    assert 0.4 < workers.fisher_exact(10**8, 10**8, 10**8 + 5_000, 10**8 - 5_000) < 0.8
    assert workers.fisher_exact(10**8, 10**8, 2 * 10**8, 10**8) == 0.0 and time.perf_counter() - began < 5
    counts = compare.counts(analyse.period_rows(spark, "/root/testdata/sf0.001")).collect()
    got = {r.metric: r.p for r in analyse.QUERIES["tests_fisher"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.metric: pytest.approx(plain_fisher(r.a, r.n1 - r.a, r.b, r.n2 - r.b), abs=1e-6) for r in counts}


def test_cleaning(spark, frame):
    days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(36)]
    df = frame([{"transaction_timestamp": t, "odometer_miles": -i, "driver_name": " \t" if i == 0 else "Bö"} for i, t in enumerate(days)])
    got = clean.clean(df.unionByName(df.limit(5))).collect()
    assert len(got) == 31 and all(r.odometer_miles >= 0 for r in got) and sum(r.driver_name is None for r in got) == 1
    assert tuple(clean.counts(df.unionByName(df.limit(5))).first()) == (41, 5, 5, 31)
    full = frame([{"transaction_timestamp": t, "odometer_miles": i} for i, t in enumerate(days[:31])])
    assert clean.clean(full).count() == 31 and clean.clean(frame([])).count() == 0
    assert clean.clean(frame([{"transaction_timestamp": None}, {"transaction_timestamp": datetime(2024, 2, 2)}])).count() == 1
    text = full.withColumn("transaction_amount", F.lit("12.5x")).withColumn("transaction_timestamp", F.lit("invalid"))
    assert {(r.column_name, r.introduced) for r in clean.introduced_nulls(text).collect()} == {("transaction_amount", 31), ("transaction_timestamp", 31)}
    with pytest.raises(config.ConfigError, match="driver_name, merchant_name"):
        clean.require(full.drop("driver_name", "merchant_name"))


def test_features(frame):
    df = frame([{"transaction_timestamp": datetime(2024, 12, 30, 5), "product_category": " Diesel\t", "fuel_volume_gallons": 0.0, "engine_runtime_minutes": 5.0}, {"transaction_timestamp": datetime(2024, 12, 30, 5), "distance_miles": 3.0, "odometer_miles": 2}, {"transaction_timestamp": None, "product_category": None, "distance_miles": None, "location_index": None}])
    a, b, c = sorted(features.features(df).collect(), key=lambda r: (r.transaction_timestamp is None, r.odometer_miles))
    assert (a.year, a.week_number, a.weekday, a.hour, a.product_clean, a.is_diesel_def, a.cost_per_gallon, a.fillups_per_day) == (2025, 1, 0, 5, "diesel", True, None, 1)
    assert a.idle_percentage == 100.0 and not a.is_business_hours and a.time_of_day_category == "Early Morning" and a.is_first_transaction_of_day and not b.is_first_transaction_of_day
    assert b.distance_miles == 3.0  # two distances in a day: granular telemetry
    assert (c.is_weekend, c.is_business_hours, c.time_of_day_category, c.product_clean, c.branch_group, c.has_eld_activity, c.fillups_per_day) == (True, False, "Unknown", "unknown", "Other Branches", False, None)
    daily = features.telemetry(features.dates(df.withColumn("distance_miles", F.lit(7.0)))).collect()
    assert sorted(r.distance_miles or 0 for r in daily) == [0, 7.0, 7.0]


def test_period_and_quality(frame, spark):
    one = frame([{"transaction_timestamp": datetime(2023, m, 1)} for m in range(1, 13)] + [{"transaction_timestamp": datetime(2024, m, 1)} for m in range(1, 6)])
    assert split.period(one).first().status == "split"
    assert split.period(one.where("transaction_timestamp < timestamp_ntz'2024-03-01'")).first().status == "insufficient"
    assert split.period(one.where("year(transaction_timestamp) = 2024")).first().status == "single"
    x = features.features(one)
    assert split.in_period(x).where("in_period").count() == 5
    assert split.label(x.where("year(transaction_timestamp) = 2024")).first().period == "2024 YTD (Jan-May)"
    q = spark.createDataFrame([(float(v), None) for v in [*range(20), 1000]], "v double, w double")
    assert [(r.column_name, r.outliers) for r in quality.outliers(q).collect()] == [("v", 1)] and quality.missing(q).first().fraction == 1.0
    assert quality.duplicates(q.unionByName(q)).first().duplicates == 21


def test_patterns_and_risk(frame):
    t = datetime(2024, 3, 4, 8)
    rows = [{"transaction_timestamp": t + timedelta(minutes=10 * i), "driver_name": "A", "merchant_name": f"S{i}", "product_category": "Gas", "distance_miles": None, "odometer_miles": i} for i in range(4)]
    rows += [{"transaction_timestamp": t + timedelta(days=i), "driver_name": "B", "product_category": "diesel", "transaction_amount": 500.0, "fuel_volume_gallons": 90.0, "odometer_miles": i, "vehicle_index": 9} for i in range(1, 13)]
    x = features.features(frame(rows))
    p = patterns.red_flags(patterns.day_patterns(x)).collect()
    assert [(r.driver_name, r.fillup_count, r.red_flags, r.suspicion_score) for r in p] == [("A", 4, "LC LV ND MF MS NE RS", 12)]
    assert patterns.shared_days(x).count() == 4 and patterns.stations(x).count() == 5
    assert [r.driver_name for r in risk.profile(x).collect()] == ["B"]
    assert risk.fleet_volume(x).first().drivers == 2 and risk.multi_days(x).where("driver_name = 'A'").first().max_fillups == 4


def test_series_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = {f"e{i}": rng.normal(size=n).round(1) + np.linspace(0, i, n) for i, n in enumerate([2, 3, 5, 6, 12, 30])} | {"flat": np.ones(8)}
    rows = [("driver", e, "m", f"2024-{i:02d}", float(v)) for e, x in data.items() for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, "entity_type string, entity_id string, metric string, month string, value double")
    mk = {r.entity_id: r for r in temporal.mann_kendall(s).collect()}
    cu = {r.entity_id: r.change_month for r in temporal.cusum(s, 0.5, 2.0).collect()}
    ac = {r.entity_id: r.acf1 for r in temporal.autocorrelation(s).collect()}
    for e, x in data.items():
        assert mk[e].s == sum(np.sign(x[j] - x[i]) for i in range(len(x)) for j in range(i + 1, len(x)))
        z, p, m, first = (x - x.mean()) / (x.std(ddof=1) or 1), 0.0, 0.0, None
        for i in range(1, len(x)):
            p, m = max(0, p + z[i] - 0.5), min(0, m + z[i] + 0.5)
            if first is None and max(p, -m) > 2.0:
                first = f"2024-{i:02d}"
        assert cu.get(e) == first
        if len(x) >= 5 and np.ptp(x):
            d = x - x.mean()
            assert abs(ac[e] - (d[1:] * d[:-1]).sum() / (d * d).sum()) < 1e-9
    assert "flat" not in ac and mk["flat"].trend == "no_trend" and mk["e0"].trend == "insufficient_data"
    assert temporal.rolling_outliers(s).count() == 0
    up = {r.entity_id: r.longest for r in temporal.escalations(s).collect()}
    for e, x in data.items():
        best = run = 0
        for c in np.diff(x) / np.where(x[:-1] == 0, 1, x[:-1]):
            run = run + 1 if c > 0 else 0
            best = max(best, run)
        assert up.get(e, 0) == (best if best >= 3 else 0)
    assert temporal.halves(s).where("entity_id = 'e5'").first().n1 == 15


def test_sources_and_report(spark, tmp_path, frame):
    df = frame([{"odometer_miles": i} for i in range(3)])
    df.write.parquet(str(tmp_path / "x.parquet"))
    assert readers.load(spark, config.Sources(merged="x.parquet"), str(tmp_path)).count() == 3
    (tmp_path / "y.csv").write_text("a,b\n1,2\n")
    assert readers.read(spark, str(tmp_path / "y.csv")).columns == ["a", "b"]
    assert readers.slug("Ünïted  Branch/No. 5") == "United-Branch-No-5" and readers.slug("con") == "Con-File" and readers.slug("") == "Unnamed"
    assert report.fill("{a} {b}", {"a": 1}) == "1 {MISSING:b}" and report.fill("{a} {b:,.2f}", {"a": 1}) == "1 {MISSING:b}"
    assert report.fill("{a:,.2f}|{b:>6.1f}|{c:.1%}|{d:>5.1f}", {"a": "1,234.5", "b": "x", "c": "12%", "d": None}) == "1,234.50|     x|12.0%|  N/A"
    assert report.interval(1, 2.5) == "[1.00, 2.50]" and report.interval(None, 1) == "N/A" and report.day(datetime(2024, 3, 1)) == "2024-03-01"
    months = [{"month": "2024-01", "metric": "a", "entities": ["y", "x", "y"]}, {"month": "2024-01", "metric": "b", "entities": None}, {"month": "2024-02", "metric": "a", "entities": ["z"]}]
    assert report.entities_by_metric(months, "2024-01", empty="-") == "a: [x, y]; b: -" and report.entities_by_metric(months, "2025-01") == ""
    assert report.currency(-2.5) == "-$2.50" and report.percent(None) == "N/A" and report.is_missing("n/a") and not report.is_missing(False)
    fuel = df.select("vehicle_id", "transaction_timestamp", "odometer_miles")
    trips = spark.createDataFrame([("x", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0)] * 2, "vehicle_id string, date timestamp_ntz, distance_miles double, idle_duration_minutes double, driving_duration_minutes double, engine_runtime_minutes double")
    assert [r.distance_miles for r in readers.merge(fuel, trips).collect()] == [2.0] * 3


def test_intervals_read_their_rows_once(spark, monkeypatch):
    """Four statistics share one pass over the rows, which may be a long way from the tables."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rng = np.random.default_rng(8)
    a, b = rng.gamma(2.0, 50.0, 300), rng.gamma(3.0, 5.0, 300) + 1
    df = spark.createDataFrame([(float(x), float(y), False) for x, y in zip(a, b)] + [(None, 1.0, False), (1e6, 1.0, True)], "transaction_amount double, fuel_volume_gallons double, has_eld_activity boolean")
    monkeypatch.setattr(analyse, "target_rows", lambda s, d: df.mapInPandas(counted, df.schema))
    got = {r.statistic: r for r in analyse.QUERIES["tests_bootstrap_statistics"](spark, "").collect()}
    assert seen.value == df.count()
    for name, value in (("median", np.median(a)), ("p90", np.quantile(a, 0.9)), ("trimmed mean", np.sort(a)[30:-30].mean()), ("cost per gallon", a.sum() / b.sum())):
        assert got[name].low < value < got[name].high < 1.5 * got[name].low


@pytest.mark.parametrize("n, share", [(1, 0.5), (2, 0.5), (7, 0.9), (30, 0.25)])
def test_ranks_of_resamples_have_their_distribution(n, share):
    """Rows at neighbouring ranks, drawn one after the other, against resamples in full."""
    ranks = workers.quantile(share).ranks(n)
    got = workers._ranked(60_000, n, ranks, 1)
    full = np.sort(np.random.default_rng(2).integers(0, n, (60_000, n)), axis=1)[:, ranks]
    both = lambda x: np.histogram2d(x[:, 0], x[:, 1], bins=n, range=((-0.5, n - 0.5),) * 2)[0] / len(x)
    assert (got[:, 0] <= got[:, 1]).all() and np.abs(both(got) - both(full)).max() < 0.01


def test_exposure_reads_its_rows_once(spark):
    """Test, mean and interval share one pass; no row where the target isn't worse."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(i < 100, i % 100 >= (60 if i < 100 else 10), 20.0 + i % 7) for i in range(300)] + [(True, False, None)]
    df = spark.createDataFrame(rows, "is_target boolean, has_eld_activity boolean, transaction_amount double")
    small = config.Config(performance=config.Performance(n_bootstrap=500))
    got = compare.exposure(df.mapInPandas(counted, df.schema), small).first()
    assert seen.value == len(rows)
    plain = compare.exposure(df, small, interval=False).first()
    assert (got.excess, got.mean_unverified, got.exposure) == tuple(plain) and got.exposure_low < got.exposure < got.exposure_high
    assert compare.exposure(df.withColumn("is_target", ~F.col("is_target")), small).count() == 0


def test_hodges_lehmann_passes_shuffle_values_once(spark, monkeypatch):
    """Each pass counts for 48 numbers, but shuffles a value to the blocks that it meets; blocks with many values are dealt to several tasks."""
    import glob
    import os

    monkeypatch.setattr(compare, "PAIRS", 1000)
    monkeypatch.setattr(compare, "HELD", 300, raising=False)
    monkeypatch.setattr(compare, "MET", 200, raising=False)
    rng = np.random.default_rng(9)
    a, b = rng.gamma(2.0, 50.0, 3001), np.r_[rng.gamma(2.0, 47.0, 4000), np.full(900, 61.5)]
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    written = lambda: {f: os.path.getsize(f) for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "v double, first boolean")
    before = written()
    got = compare.hodges_lehmann(df, "v", "first").first().shift
    assert abs(got - np.median(a[:, None] - b[None, :])) < 1e-9
    assert sum(size for f, size in written().items() if f not in before) < 8e5

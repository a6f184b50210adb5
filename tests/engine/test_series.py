"""Folds over series, the whole temporal score, its findings in words, and the family without empty tests."""

from datetime import datetime
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import folds
from ledgerlens.operators import clean, compare, features, split, temporal
from ledgerlens.plans import series
from ledgerlens.sources import bucketed

from .test_engine import frame  # noqa: F401


def best_breaks(x, least=2, step=5):
    """The optimal segmentation by trying every begin of every last segment."""
    n, d = len(x), (x[:, None] - x[None, :]) ** 2
    m = np.median(d[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(d / m if m > 0 else d, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    points = [p for p in range(0, n) if p == 0 or (p % step == 0 and p >= least)] + [n]
    best, back = {0: -2 * np.log(n)}, {}
    for e in points[1:]:
        best[e], back[e] = min((best[s] + e - s - k[s:e, s:e].sum() / (e - s) + 2 * np.log(n), s) for s in points if s < e and e - s >= least)
    out, e = [], n
    while back[e]:
        e = back[e]
        out.append(e)
    return out[::-1]


@pytest.mark.parametrize("step", [1, 5])
def test_segmentation_is_optimal(spark, step):
    rng = np.random.default_rng(step)
    series = []
    for k in range(24):
        n = int(rng.integers(6, 30))
        jump = np.r_[rng.normal(0, 1, n // 2), rng.normal(rng.integers(0, 12), 1, n - n // 2)]
        series.append(jump if k % 3 else rng.integers(0, 3, n).astype(float))
    series += [np.r_[np.zeros(30), np.ones(30) * 5, np.zeros(30)], np.full(9, 2.0), np.arange(5.0)]
    rows = [(k, i, float(v)) for k, x in enumerate(series) for i, v in enumerate(x)] + [(0, 99, None)]
    got = {r.k: r.change_points for r in folds.segments(spark.createDataFrame(rows, "k int, i int, v double"), ("k",), "i", "v", shift=0, step=step).collect()}
    assert got.pop(24) == [30, 60] and 25 not in got and 26 not in got
    assert got == {k: best_breaks(x, step=step) for k, x in enumerate(series[:24])} and any(got.values())


def test_exact_rank_probabilities(spark):
    pairs = [(n, m, u) for n, m in ((2, 3), (3, 3), (4, 6), (8, 8), (8, 11), (5, 2)) for u in range(n * m + 1)]
    df = spark.createDataFrame([(*p, None) for p in pairs] + [(3, 3, None, 1)], "n int, m int, u int, x int")
    got = {(r.n, r.m, r.u): r.p for r in df.select("n", "m", "u", folds.exact_u_p(F.col("u").cast("double"), F.col("n"), F.col("m")).alias("p")).collect()}
    assert got.pop((3, 3, None)) is None
    for n, m in {p[:2] for p in pairs}:
        us = np.array([sum(r - i for i, r in enumerate(c)) for c in combinations(range(n + m), n)])
        for u in range(n * m + 1):
            want = min(1.0, 2 * (us <= min(u, n * m - u)).sum() / comb(n + m, n))
            assert abs(got[n, m, u] - want) < 1e-12


@pytest.fixture
def worsening(frame):
    rows = []
    for i in range(40):  # many more fill-ups from the 21st month, costs that fall
        for j in range(12 if i >= 20 else 2):
            at = datetime(2020 + i // 12, i % 12 + 1, 1 + j, 23 if i >= 36 else 12)
            rows.append({"transaction_timestamp": at, "driver_name": "A", "vehicle_index": 1, "odometer_miles": 100 * i + j, "transaction_amount": 200.0 - 3 * i})
    return features.features(frame(rows))


def test_score_counts_change_points_and_falling_costs(worsening):
    got = {r.entity_id: r for r in temporal.score(worsening, worsening).collect()}["A"]
    m = temporal.long(temporal.monthly(worsening, 20, 3)).where("entity_id = 'A'")
    values = {k: g.sort_values("month")["value"].to_numpy(float) for k, g in m.toPandas().groupby("metric")}
    assert got.points == sum(len(best_breaks(v)) for v in values.values() if np.ptp(v)) > 0
    trends = {r.metric: r.trend for r in temporal.mann_kendall(m).collect()}
    assert trends["cost_mean"] == "decreasing" and got.trends == 1 + sum(t == "increasing" for c, t in trends.items() if c != "cost_mean")
    caps = ((got.trends, 10, 20), (got.changes + got.points, 8, 25), (got.spikes, 12, 25), (got.escalations, 8, 15), (got.patterns, 15, 30), (got.persistent, 8, 15), (got.outliers, 5, 15))
    assert got.temporal_risk_score == min(100, sum(min(most, n * w) for n, w, most in caps) + got.current)


def test_findings_agree_with_the_single_detectors(worsening):
    m = temporal.monthly(worsening, 20, 3)
    s, base = temporal.long(m), temporal.baselines_of(m)
    one = {(r.entity_id, r.metric): r for r in temporal.findings(m, m).collect()}
    by = lambda df: {(r.entity_id, r.metric): r for r in df.collect()}
    kept = lambda found, metrics: {k: r for k, r in found.items() if k[1] in metrics}
    assert {k: (r.s, r.trend) for k, r in one.items()} == {k: (r.s, r.trend) for k, r in by(temporal.mann_kendall(s)).items()}
    assert {k: r.change.month for k, r in one.items() if r.change} == {k: r.change_month for k, r in by(temporal.cusum(s, 0.5, 3.5)).items()}
    assert {k: ",".join(r.spike_months) for k, r in one.items() if r.spike_months} == {k: r.spike_months for k, r in kept(by(temporal.spikes(s, base)), temporal.BEHAVIOURAL).items()}
    assert {k: r.risk_level for k, r in one.items() if r.risk_level} == {k: r.risk_level for k, r in kept(by(temporal.autocorrelation(s)), temporal.RATES).items()}
    assert all(not r.outlier_months for r in one.values())


def test_findings_in_words(worsening):
    rows = {r.entity_id: r for r in temporal.indicators(temporal.monthly(worsening, 20, 3), temporal.monthly(worsening, 3, 3)).collect()}
    texts = rows["A"].indicators
    assert texts[:2] == ["INCREASING Transaction Volume", "INCREASING After Hours Rate"] or texts[0] == "INCREASING Transaction Volume"
    assert "DECREASING average cost (potential passenger vehicle use)" in texts and any(t.startswith("SUDDEN SPIKE in Transaction Volume (+") for t in texts)
    assert "OFF-HOURS CONCENTRATION PATTERN (excessive non-business hour activity)" in texts
    assert rows["A"].current_factors[-1] == "High After Hours Rate (100.0%)"
    assert rows["A"].total_risk_factors == len(texts) and rows["A"].recent_behavior == len(rows["A"].current_factors) and rows["A"].has_fraud_patterns
    kinds = [next(i for i, k in enumerate(("INCREASING", "DECREASING", "SUDDEN", "GRADUAL ESCALATION in", "ANOMALOUS", "PERSISTENT", "OFF", "SPIKE-", "GRADUAL ESCALATION PATTERN")) if t.startswith(k)) for t in texts]
    assert kinds == sorted(kinds)


def test_metrics_are_a_map_of_findings(worsening):
    m = temporal.monthly(worsening, 20, 3)
    row = temporal.analysis(m, m).where("entity_id = 'A'").first()
    assert set(row.metrics) == set(temporal.TRACKED) and row.metrics["cost_mean"].trend == "decreasing" and row.metrics["cost_mean"].n == 40


def test_tests_without_hits_are_not_of_the_family(frame):
    """By day on weekdays only: no row is after hours, and all but two have a telemetry match."""
    rows = [{"transaction_timestamp": datetime(2024, 1, 1 + i % 5, 9, i), "odometer_miles": i, "transaction_amount": 50.0 + i, "location_index": 4 if i % 2 else 1, "distance_miles": None if i in (1, 3) else 5.0} for i in range(40)]
    df = features.features(frame(rows))
    p = {r.metric: r for r in compare.proportions(compare.counts(df)).collect()}
    got = {r.metric: r for r in compare.family(df).collect()}
    assert p["After-Hours"].p_value == 1.0 and "After-Hours" not in got
    family = sorted((k for k in p if 0 < p[k].a + p[k].b < p[k].n1 + p[k].n2), key=lambda k: p[k].p_value)
    assert set(got) == {*family, "Cost Distribution"}
    ps = np.sort([r.p_value for r in got.values()])
    q = np.minimum.accumulate((ps * len(ps) / np.arange(1, len(ps) + 1))[::-1])[::-1]
    np.testing.assert_allclose(sorted(r.q_value for r in got.values()), np.minimum(q, 1))


@pytest.mark.parametrize("text", [False, True])
def test_counts_come_with_the_job_over_the_frame(frame, text):
    rows = [{"transaction_timestamp": datetime(2024, 1, 1 + i % 28, 9), "odometer_miles": i % 50} for i in range(60)] + [{"transaction_timestamp": datetime(2024, 2, 2, 9)}] * 3
    df = frame(rows)
    if text:
        df = df.withColumn("transaction_timestamp", F.col("transaction_timestamp").cast("string"))
    steps = features.Steps()
    x = features.prepared(df, steps=steps)
    n = len(x.collect())
    assert steps.counts() == clean.counts(df).first().asDict() and steps.counts()["final"] == n
    assert steps.counts()["duplicates"] > 0 and steps.counts()["incomplete"] > 0


def test_a_bucketed_table_needs_no_shuffle(spark, frame, tmp_path):
    rows = [{"transaction_timestamp": datetime(2024, 1, 1 + i % 28, 9, i % 7), "odometer_miles": i % 50, "vehicle_index": i % 9 or None, "distance_miles": float(i % 3)} for i in range(90)]
    df = frame(rows + rows[:20])
    bucketed.write(df, "bucketed_test", f"file://{tmp_path}/t", buckets=4)
    x = features.prepared(bucketed.read(spark, "bucketed_test"))
    plain = features.prepared(df)
    assert sorted(x.columns) == sorted(plain.columns)
    assert sorted(map(str, x.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    exchanges = lambda d: [line for line in d._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and ("_spread" in line or "merchant" in line)]
    assert exchanges(plain) and not exchanges(x), exchanges(x)
    spark.sql("drop table bucketed_test")


def test_rolling_outliers_at_the_limit(spark):
    """Months exactly two deviations away are none, as in DuckDB, whatever bits the rates have; windows with gaps, single values and equal ones."""
    import duckdb

    given = {"A": [100 * (8 / 12), 100 * (7 / 12), 50.0, 75.0], "B": [100 * (1 / 3), None, 25.0, 0.0, 0.0, 0.0, 50.0], "C": [5.0, 1.0]}
    rng = np.random.default_rng(6)
    given |= {f"R{i}": [100 * (int(rng.integers(0, 5)) / int(k)) for k in rng.integers(4, 13, 40)] for i in range(40)}
    rows = [("driver", e, "after_hours_rate", f"2020-{i:03d}", v) for e, values in given.items() for i, v in enumerate(values)]
    got = temporal.rolling_outliers(spark.createDataFrame(rows, "entity_type string, entity_id string, metric string, month string, value double"), exclusive=True)
    sql = series.QUERIES["series_rolling_exclusive"].sql.rpartition(" from (select * from (select *, case")[2]
    con = duckdb.connect()
    con.execute("create table ls (entity_type varchar, entity_id varchar, metric varchar, month varchar, value double)")
    con.executemany("insert into ls values (?, ?, ?, ?, ?)", rows)
    want = con.execute(f"select entity_id, month from (select * from (select *, case{sql}").fetchall()
    assert sorted((r.entity_id, r.month) for r in got.collect()) == sorted(want) and len(want) > 50 and ("A", "2020-003") not in want


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("kind", ["split", "insufficient", "single", "no times"])
def test_rows_of_the_period_alone(frame, kind, text):
    """As if all rows had been prepared first: copies, an unfinished last month, rows without times or vehicles."""
    months = {"split": 17, "insufficient": 15, "single": 5, "no times": 0}[kind]
    rows = [{"transaction_timestamp": datetime(2023 + m // 12, 1 + m % 12, d, 9), "odometer_miles": m % 5, "vehicle_index": d % 4 or None, "distance_miles": float(d % 2)} for m in range(months) for d in (3, 3, 27, 28)]
    rows += [{"transaction_timestamp": datetime(2024, months - 11, 2, 8)}] * 2 if months > 12 else []
    df = frame(rows + [{"transaction_timestamp": None, "odometer_miles": i % 2} for i in range(4)])
    if text:
        df = df.withColumn("transaction_timestamp", F.col("transaction_timestamp").cast("string"))
    want = split.in_period(features.prepared(df, steps=features.Steps())).where("in_period").drop("in_period")
    got = features.prepared(df, current=True)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_many_series_are_measured_fast(spark):
    """S, ties and breaks of 2,000 series of 82 months in seconds, equal to the folds and to the optimum; nulls and short arrays too."""
    import time

    rng = np.random.default_rng(10)
    given = [np.r_[rng.normal(0, 1, 41), rng.normal(k % 4 * 3, 1, 41)].round(1) + 0.0 for k in range(2000)]
    rows = [(k, x.tolist()) for k, x in enumerate(given)] + [(-1, None), (-2, []), (-3, [1.0]), (-4, [2.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(4).persist()
    got = {r.k: r for r in df.select("k", folds.breaks(F.col("v")).alias("breaks")).collect()}
    began = time.perf_counter()
    df.select(folds.breaks(F.col("v"))).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 4
    assert all(got[k].breaks == best_breaks(given[k]) for k in range(60)) and got[-1].breaks is None and got[-2].breaks == got[-3].breaks == []
    few = df.where("k < 60 and v is not null").select("k", folds.measured(F.col("v")).alias("m"), folds.kendall_s(F.col("v")).alias("s"), folds.ties(F.col("v")).alias("t")).collect()
    assert len(few) == 63 and all((r.m.s, r.m.ties) == (r.s, r.t) for r in few)
    df.unpersist()

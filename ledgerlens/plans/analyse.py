"""Queries over risk, patterns and statistical comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks, stats, workers
from ..operators import compare, patterns, risk, split
from .base import CONFIG, Query, transactions


def period_rows(spark, d):
    return transactions(spark, d, current=True)


def target_rows(spark, d):
    return period_rows(spark, d).where("is_target")


def _metrics_sql(entity: str, source: str = "tp") -> str:
    return f"""select {entity}, count(datetime_parsed) as total_transactions, count(*) filter (where not has_eld_activity) as no_eld_count, count(*) filter (where not is_diesel_def) as non_diesel_count,
        count(*) filter (where not is_business_hours) as after_hours_count, coalesce(sum(transaction_amount), 0) as total_cost from {source} where {entity} is not null group by 1"""


def _rank_sql(c: str) -> str:
    return f"(rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0e0) / count({c}) over () * 100"


def profile_sql(entity: str, source: str = "tp") -> tuple[str, str]:
    """Common tables and the name of the profile of an entity."""
    w = {n: stats.wilson_sql(f"{n}_count", "total_transactions") for n in risk.RATES}
    ci = ", ".join(f"{low} as {n}_ci_lower, {high} as {n}_ci_upper" for n, (low, high) in w.items())
    rate = ", ".join(f"{n}_count / cast(total_transactions as double) as {n}_rate" for n in risk.RATES)
    pct = ", ".join(f"{_rank_sql(f'{n}_rate')} as {n}_percentile" for n in risk.RATES)
    name = f"profile_{entity}"
    return name, f"""
      m_{entity} as (select * from ({_metrics_sql(entity, source)}) where total_transactions >= 10),
      r_{entity} as (select *, {rate}, total_cost / total_transactions as avg_cost_per_transaction, {ci} from m_{entity}),
      p_{entity} as (select *, {pct}, {_rank_sql('avg_cost_per_transaction')} as cost_percentile from r_{entity}),
      s_{entity} as (select *, abs(cost_percentile - 50) * 2 as cost_deviation_score from p_{entity}),
      {name} as (select *, {stats.risk_band_sql('composite_risk_score')} as risk_band, no_eld_ci_lower > 0.20e0 as no_eld_risk_flag, non_diesel_ci_lower > 0.15e0 as non_diesel_risk_flag, after_hours_ci_lower > 0.25e0 as after_hours_risk_flag
        from (select *, no_eld_percentile * 0.30e0 + non_diesel_percentile * 0.25e0 + after_hours_percentile * 0.25e0 + cost_deviation_score * 0.20e0 as composite_risk_score from s_{entity}))"""


DRIVER, DRIVER_CTE = profile_sql("driver_name")
VEHICLE, VEHICLE_CTE = profile_sql("vehicle_id")
PROFILE_COLUMNS = "total_transactions no_eld_rate:6 no_eld_ci_lower:6 no_eld_ci_upper:6 non_diesel_rate:6 after_hours_rate:6 avg_cost_per_transaction:4 no_eld_percentile:6 cost_deviation_score:6 composite_risk_score:6 no_eld_risk_flag non_diesel_risk_flag after_hours_risk_flag risk_band"
PATTERN_CTE = """
  dp as (select driver_name, date_only, count(distinct datetime_parsed) as fillup_count, array_to_string(list_sort(list(distinct product_clean)), ', ') as products, sum(transaction_amount) as total_cost, avg(transaction_amount) as avg_cost,
         avg(fuel_volume_gallons) as avg_volume, count(distinct merchant_name) as unique_stations, (epoch(max(datetime_parsed)) - epoch(min(datetime_parsed))) / 3600.0e0 as time_span_hours, bool_and(has_eld_activity) as has_eld_match,
         count(*) filter (where is_diesel_def) as diesel_count, 1 - count(*) filter (where is_diesel_def) / cast(count(distinct datetime_parsed) as double) as non_diesel_rate
         from tp where driver_name is not null group by 1, 2 having count(*) >= 2),
  fl as (select dp.*, coalesce(avg_cost <= qc, false) as lc, coalesce(avg_volume <= qv, false) as lv, non_diesel_rate >= 0.5 as nd, fillup_count >= 4 as mf, unique_stations > 1 as ms, not has_eld_match as ne, fillup_count >= 3 and time_span_hours < 1 as rs
         from dp, (select quantile_cont(avg_cost, 0.25) as qc, quantile_cont(avg_volume, 0.25) as qv from dp)),
  rf as (select *, concat_ws(' ', case when lc then 'LC' end, case when lv then 'LV' end, case when nd then 'ND' end, case when mf then 'MF' end, case when ms then 'MS' end, case when ne then 'NE' end, case when rs then 'RS' end) as red_flags,
         cast(lc as integer) + cast(lv as integer) + 2 * cast(nd as integer) as fraud_indicators, cast(mf as integer) + cast(ms as integer) + cast(ne as integer) + cast(rs as integer) as misuse_indicators from fl),
  rs as (select *, 2 * fraud_indicators + misuse_indicators as suspicion_score from rf)"""
STATION_CTE = """
  st as (select *, transaction_count / sum(transaction_count) over () as pct_of_total from (select merchant_name, count(datetime_parsed) as transaction_count, count(distinct driver_name) as unique_drivers, count(distinct vehicle_id) as unique_vehicles, sum(transaction_amount) as total_cost,
         avg(transaction_amount) as avg_cost, avg(cast(not has_eld_activity as integer)) as no_eld_rate, avg(cast(not is_diesel_def as integer)) as non_diesel_rate, avg(fuel_volume_gallons) as avg_volume from tp group by 1)),
  sf as (select st.*, non_diesel_rate >= a as high_non_diesel, no_eld_rate >= b as high_no_eld, avg_cost <= c as low_avg_cost, 2 * cast(non_diesel_rate >= a as integer) + cast(no_eld_rate >= b as integer) + cast(avg_cost <= c as integer) as suspicion_flags
         from st, (select quantile_cont(non_diesel_rate, 0.75) as a, quantile_cont(no_eld_rate, 0.75) as b, quantile_cont(avg_cost, 0.25) as c from st))"""
FLAG_SQL = {"No ELD Match": "not has_eld_activity", "Non-Diesel/DEF": "not is_diesel_def", "After-Hours": "not is_business_hours", "Multiple Same-Day Fillups": "fillups_per_day > 1"}
_COUNT = " union all ".join(f"select '{m}' as metric, count(*) filter (where is_target and {c}) as a, count(*) filter (where is_target) as n1, count(*) filter (where not is_target and {c}) as b, count(*) filter (where not is_target) as n2 from px where in_period" for m, c in FLAG_SQL.items())


def _tests_sql(continuity: bool = False) -> str:
    e = stats.two_by_two_sql("a", "n1", "b", "n2", continuity=continuity)
    first = ", ".join(f"{v} as {k}" for k, v in e.items() if k != "p_value")
    return f"select *, {e['p_value']} as p_value from (select *, {first} from ct)"


TEST_CTE = f"ct as ({_COUNT}), te as ({_tests_sql()}), pp as (select * from px where in_period)"
_U = ranks.rank_test_sql("pp", "transaction_amount", "is_target")
_FAMILY = f"select metric, z as statistic, cramers_v as effect, p_value from te where a + b between 1 and n1 + n2 - 1 union all select 'Cost Distribution', u, cliffs_delta, p_value from ({_U}) where p_value is not null"
TEST_COLUMNS = "metric a n1 b n2 rate_1:6 rate_2:6 risk_ratio:6 risk_ratio_low:6 risk_ratio_high:6 odds_ratio:6 odds_ratio_low:6 odds_ratio_high:6 z:5 p_value:6 chi2:4 cramers_v:6 difference_low:6 difference_high:6"


def _flagged(spark, d):
    return patterns.red_flags(patterns.day_patterns(target_rows(spark, d)))


def _intervals(spark, d):
    """Intervals of the median, a high quantile, the trimmed mean and the cost of a gallon over the target's unmatched rows."""
    rows = target_rows(spark, d).where("not has_eld_activity").select("transaction_amount", "fuel_volume_gallons")
    asked = {"median": (workers.quantile(0.5), "transaction_amount", None), "p90": (workers.quantile(0.9), "transaction_amount", None), "trimmed mean": (workers.trimmed_mean(0.1), "transaction_amount", None), "cost per gallon": (workers.ratio(), "transaction_amount", "fuel_volume_gallons")}
    return workers.bootstraps(rows, asked, CONFIG.performance.n_bootstrap)


_LOG = """select n, skew, kurtosis, p99_ratio, tail_share, dispersion_drop, n >= 30 and lowest >= 0 and (skew > 1 or kurtosis > 3 or p99_ratio >= 3 or tail_share > 0.02) and dispersion_drop >= 0.2 as advised from (
   select a.n, lowest, skew, kurtosis, p99 / p50 as p99_ratio, tail_share, coalesce(1 - (lmad / lm) / (mad / p50), 0) as dispersion_drop from a, b)"""
_LOG_CTE = """a as (select count(v) as n, min(v) as lowest, skewness(v) as skew, kurtosis(v) as kurtosis, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.99) as p99, quantile_cont(ln(1 + v), 0.5) as lm from (select transaction_amount as v from tp)),
   b as (select quantile_cont(abs(v - p50), 0.5) as mad, quantile_cont(abs(ln(1 + v) - lm), 0.5) as lmad, avg(cast(v > p50 + 3 * (p75 - p25) as integer)) as tail_share from (select transaction_amount as v from tp), a)"""

_LF = lambda x: f"lgamma(cast({x} as double) + 1)"
_TERM = lambda x: f"(-({_LF(x)} + {_LF(f'n1 - {x}')} + {_LF(f'k - {x}')} + {_LF(f'n2 - k + {x}')}))"
_FISHER = f"""select metric, least(1.0e0, sum(exp(t - top)) filter (where t <= ta + 1e-7) / sum(exp(t - top))) as p from (
   select *, max(t) over (partition by metric) as top from (select metric, {_TERM('a')} as ta, {_TERM('x')} as t from (
     select metric, a, n1, n2, a + b as k, unnest(range(greatest(0, a + b - n2), least(a + b, n1) + 1)) as x from ct))) group by metric"""
_VIF = ("fuel_volume_gallons", "transaction_amount", "idle_duration_minutes", "driving_duration_minutes")


def _det(rows: list[list[str]]) -> str:
    """The determinant by its first row, as SQL."""
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " + ".join(f"{'-' if j % 2 else ''}({x}) * {_det([r[:j] + r[j + 1 :] for r in rows[1:]])}" for j, x in enumerate(rows[0])) + ")"


def _vif_sql(columns: tuple[str, ...]) -> str:
    """A diagonal element of the products' matrix times that of its inverse; the products are scaled to a diagonal of ones first."""
    at = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    k = range(len(columns))
    sums = ", ".join(f"sum({columns[i]} * {columns[j]}) / sqrt(sum({columns[i]} * {columns[i]}) * sum({columns[j]} * {columns[j]})) as {at(i, j)}" for i in k for j in k if i <= j)
    matrix = [[at(i, j) for j in k] for i in k]
    minors = ", ".join(f"{_det([[x for j, x in enumerate(r) if j != i] for n, r in enumerate(matrix) if n != i])} / det" for i in k)
    given = " and ".join(f"{c} is not null" for c in columns)
    return f"select unnest({list(columns)}) as feature, unnest([{minors}]) as vif from (select *, {_det(matrix)} as det from (select {sums} from tp where {given}))"


QUERIES = {
    "risk_driver_metrics": Query("driver_name total_transactions no_eld_count non_diesel_count after_hours_count total_cost:2", lambda s, d: risk.metrics(target_rows(s, d)), _metrics_sql("driver_name")),
    "risk_driver_profile": Query("driver_name " + PROFILE_COLUMNS, lambda s, d: risk.profile(target_rows(s, d)), f"select * from {DRIVER}", DRIVER_CTE),
    "risk_top_drivers": Query("driver_name composite_risk_score:6 risk_band", lambda s, d: risk.top(risk.profile(target_rows(s, d)), "composite_risk_score", "driver_name"), f"select * from {DRIVER} order by composite_risk_score desc, driver_name limit 10", DRIVER_CTE),
    "risk_vehicle_profile": Query("vehicle_id primary_driver " + PROFILE_COLUMNS, lambda s, d: risk.vehicles(target_rows(s, d)),
        f"select p.*, m.primary_driver from {VEHICLE} p left join (select vehicle_id, driver_name as primary_driver from (select vehicle_id, driver_name, row_number() over (partition by vehicle_id order by count(*) desc, driver_name) as r from tp where driver_name is not null group by 1, 2) where r = 1) m using (vehicle_id)", VEHICLE_CTE),
    "risk_volumes": Query("driver_name transactions total_volume:2 avg_volume:6 total_cost:2 volume_z:6", lambda s, d: risk.volumes(target_rows(s, d)),
        """select *, (total_volume - avg(total_volume) over ()) / nullif(stddev_samp(total_volume) over (), 0) as volume_z from (select driver_name, count(datetime_parsed) as transactions, sum(fuel_volume_gallons) as total_volume, avg(fuel_volume_gallons) as avg_volume, sum(transaction_amount) as total_cost
           from tp where driver_name is not null group by 1 having count(datetime_parsed) >= 10)"""),
    "risk_fleet_volume": Query("drivers mean_volume:4 std_volume:4", lambda s, d: risk.fleet_volume(target_rows(s, d)), "select count(v) as drivers, avg(v) as mean_volume, stddev_samp(v) as std_volume from (select sum(fuel_volume_gallons) as v from tp where driver_name is not null group by driver_name)"),
    "risk_products": Query("driver_name product_clean n cost:2 share:6", lambda s, d: risk.products(target_rows(s, d)),
        "select driver_name, product_clean, count(*) as n, sum(transaction_amount) as cost, count(*) / sum(count(*)) over (partition by driver_name) as share from tp where driver_name is not null group by 1, 2"),
    "risk_multi_days": Query("driver_name multi_days max_fillups multi_day_amount:4", lambda s, d: risk.multi_days(target_rows(s, d)),
        "select driver_name, count(distinct case when fillups_per_day > 1 then date_only end) as multi_days, coalesce(max(case when fillups_per_day > 1 then fillups_per_day end), 0) as max_fillups, coalesce(avg(case when fillups_per_day > 1 then transaction_amount end), 0) as multi_day_amount from tp where driver_name is not null group by 1"),
    "risk_deep_dive": Query("driver_name composite_risk_score:6 vehicles multi_days max_fillups main_product main_share:6", lambda s, d: risk.deep_dive(target_rows(s, d)),
        f"""select f.driver_name, f.composite_risk_score, v.vehicles, v.multi_days, v.max_fillups, m.product_clean as main_product, m.share as main_share from (select * from {DRIVER} order by composite_risk_score desc, driver_name limit 3) f
            left join (select driver_name, count(distinct vehicle_id) as vehicles, count(distinct case when fillups_per_day > 1 then date_only end) as multi_days, coalesce(max(case when fillups_per_day > 1 then fillups_per_day end), 0) as max_fillups from tp group by 1) v using (driver_name)
            left join (select driver_name, product_clean, share from (select driver_name, product_clean, count(*) / sum(count(*)) over (partition by driver_name) as share, row_number() over (partition by driver_name order by count(*) desc, product_clean) as r from tp group by 1, 2) where r = 1) m using (driver_name)""", DRIVER_CTE),
    "risk_histogram": Query("risk_band n", lambda s, d: risk.profile(target_rows(s, d)).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n")), f"select risk_band, count(*) as n from {DRIVER} group by 1", DRIVER_CTE),
    "patterns_shared_days": Query("driver_name n", lambda s, d: patterns.shared_days(target_rows(s, d)).groupBy("driver_name").agg(F.count(F.lit(1)).alias("n")),
        "select driver_name, sum(k) as n from (select driver_name, date_only, count(*) as k from tp where driver_name is not null group by 1, 2 having count(*) >= 2) group by 1".replace("sum(k)", "cast(sum(k) as bigint)")),
    "patterns_days": Query("driver_name date_only fillup_count products total_cost:4 avg_cost:4 avg_volume:4 unique_stations time_span_hours:6 has_eld_match diesel_count non_diesel_rate:6", lambda s, d: patterns.day_patterns(target_rows(s, d)), "select * from dp", PATTERN_CTE),
    "patterns_red_flags": Query("driver_name date_only red_flags fraud_indicators misuse_indicators suspicion_score", _flagged, "select * from rs", PATTERN_CTE),
    "patterns_summary": Query("events drivers mean_fillups:6 high_risk likely_fraud mean_score:6", lambda s, d: patterns.summary(_flagged(s, d)),
        "select count(*) as events, count(distinct driver_name) as drivers, avg(fillup_count) as mean_fillups, count(*) filter (where suspicion_score >= 4) as high_risk, count(*) filter (where fraud_indicators >= 2) as likely_fraud, avg(suspicion_score) as mean_score from rs", PATTERN_CTE),
    "patterns_tally": Query("flag n", lambda s, d: _flagged(s, d).select(F.explode(F.split("red_flags", " ")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n")), "select flag, count(*) as n from (select unnest(string_split(red_flags, ' ')) as flag from rs) where flag <> '' group by 1", PATTERN_CTE),
    "patterns_stations": Query("merchant_name transaction_count unique_drivers unique_vehicles total_cost:2 avg_cost:4 no_eld_rate:6 non_diesel_rate:6 avg_volume:4 pct_of_total:6", lambda s, d: patterns.stations(target_rows(s, d)), "select * from st", STATION_CTE),
    "patterns_suspicious_stations": Query("merchant_name transaction_count high_non_diesel high_no_eld low_avg_cost suspicion_flags", lambda s, d: patterns.suspicious_stations(target_rows(s, d)),
        "select * from sf where suspicion_flags > 0 and transaction_count >= 5 order by suspicion_flags desc, merchant_name limit 10", STATION_CTE),
    "tests_wilson": Query("driver_name no_eld_count total_transactions low:6 high:6", lambda s, d: risk.metrics(target_rows(s, d)).select("driver_name", "no_eld_count", "total_transactions", *[F.expr(e).alias(c) for e, c in zip(stats.wilson_sql("no_eld_count", "total_transactions"), ("low", "high"))]),
        f"select *, {stats.wilson_sql('no_eld_count', 'total_transactions')[0]} as low, {stats.wilson_sql('no_eld_count', 'total_transactions')[1]} as high from (select driver_name, count(*) filter (where not has_eld_activity) as no_eld_count, count(datetime_parsed) as total_transactions from tp where driver_name is not null group by 1)"),
    "tests_proportions": Query(TEST_COLUMNS, lambda s, d: compare.proportions(compare.counts(period_rows(s, d))), "select * from te", TEST_CTE),
    "tests_continuity": Query("metric p_value:6", lambda s, d: compare.proportions(compare.counts(period_rows(s, d)), continuity=True), _tests_sql(True), TEST_CTE),
    "tests_family": Query("metric statistic:3 effect:6 p_value:6 q_value:6 rejected p_band", lambda s, d: compare.family(period_rows(s, d)), f"select *, {stats.p_band_sql('p_value')} as p_band from ({ranks.bh_sql(_FAMILY)})", TEST_CTE),
    "tests_family_business_hours": Query("metric statistic:3 effect:6 p_value:6 q_value:6 rejected", lambda s, d: compare.family(period_rows(s, d).where("is_business_hours")), f"select * from ({ranks.bh_sql(_FAMILY)})", TEST_CTE.replace("where in_period", "where in_period and is_business_hours")),
    "tests_significant": Query("metric p_value:6", lambda s, d: compare.family(period_rows(s, d)).where("rejected").orderBy("p_value", "metric").select("metric", "p_value"), f"select metric, p_value from ({ranks.bh_sql(_FAMILY)}) where rejected", TEST_CTE),
    "summary_executive": Query("metric p_value:6 odds_ratio:5 risk_difference:6 notable superiority:6", lambda s, d: compare.executive(period_rows(s, d)),
        f"select f.metric, f.p_value, te.odds_ratio, te.rate_1 - te.rate_2 as risk_difference, coalesce(abs(te.rate_1 - te.rate_2) >= 0.05e0, false) as notable, case when f.metric = 'Cost Distribution' then (abs(f.effect) + 1) / 2 end as superiority from ({ranks.bh_sql(_FAMILY)}) f left join te using (metric) where f.rejected", TEST_CTE),
    "tests_cost": Query("n1 n2 u:1 cliffs_delta:6 z:5 p_value:6 mean_target:4 mean_peer:4 p25_target:4 median_target:4 p75_target:4 p25_peer:4 median_peer:4 p75_peer:4 total_target:2 total_peer:2 mean_difference:4 percent_difference:4 direction magnitude", lambda s, d: compare.cost(period_rows(s, d)),
        f"""select u.*, q.*, mean_target - mean_peer as mean_difference, (mean_target - mean_peer) / mean_peer * 100 as percent_difference, case when abs(cliffs_delta) < 0.147 then 'negligible' when cliffs_delta > 0 then 'higher' else 'lower' end as direction,
            {stats.band_sql('cliffs_delta', (0.147, 0.33, 0.474), stats.CLIFF_NAMES)} as magnitude from ({_U}) u, (select """ + ", ".join(f"avg(transaction_amount) filter (where {c}) as mean_{n}, sum(transaction_amount) filter (where {c}) as total_{n}, quantile_cont(transaction_amount, 0.25) filter (where {c}) as p25_{n}, quantile_cont(transaction_amount, 0.5) filter (where {c}) as median_{n}, quantile_cont(transaction_amount, 0.75) filter (where {c}) as p75_{n}" for n, c in (("target", "is_target"), ("peer", "not is_target"))) + " from pp) q", TEST_CTE),
    "tests_cohens_d": Query("n1 n2 m1:4 m2:4 cohens_d:6 magnitude", lambda s, d: compare.standardised(period_rows(s, d), "fuel_volume_gallons", "is_target"),
        f"select *, {stats.band_sql('cohens_d', CONFIG.effect_sizes.cohen, stats.CLIFF_NAMES)} as magnitude from (" + """select *, (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) as cohens_d from (select count(*) filter (where is_target) as n1, count(*) filter (where not is_target) as n2, avg(fuel_volume_gallons) filter (where is_target) as m1, avg(fuel_volume_gallons) filter (where not is_target) as m2,
           var_samp(fuel_volume_gallons) filter (where is_target) as v1, var_samp(fuel_volume_gallons) filter (where not is_target) as v2 from pp))""", TEST_CTE),
    "tests_hodges_lehmann_amounts": Query("shift:4", lambda s, d: compare.hodges_lehmann(target_rows(s, d), "transaction_amount", "has_eld_activity"),
        """select min(d) filter (where c * 2 >= t) * 0.5 + min(d) filter (where c * 2 > t) * 0.5 as shift from (select d, sum(w) over (order by d) as c, sum(w) over () as t from (
           select x - y as d, sum(nx * ny) as w from (select transaction_amount as x, count(*) as nx from tp where has_eld_activity group by 1), (select transaction_amount as y, count(*) as ny from tp where not has_eld_activity group by 1) group by 1))"""),
    "tests_hodges_lehmann_peers": Query("shift:4", lambda s, d: compare.hodges_lehmann(period_rows(s, d), "transaction_amount", "is_target"),
        """select min(d) filter (where c * 2 >= t) * 0.5 + min(d) filter (where c * 2 > t) * 0.5 as shift from (select d, sum(w) over (order by d) as c, sum(w) over () as t from (
           select x - y as d, sum(nx * ny) as w from (select transaction_amount as x, count(*) as nx from pp where is_target group by 1), (select transaction_amount as y, count(*) as ny from pp where not is_target group by 1) group by 1))""", TEST_CTE),
    "tests_hodges_lehmann": Query("shift:4", lambda s, d: compare.hodges_lehmann(period_rows(s, d), "fuel_volume_gallons", "is_target"),
        """select min(d) filter (where c * 2 >= t) * 0.5 + min(d) filter (where c * 2 > t) * 0.5 as shift from (select d, sum(w) over (order by d) as c, sum(w) over () as t from (
           select x - y as d, sum(nx * ny) as w from (select fuel_volume_gallons as x, count(*) as nx from pp where is_target group by 1), (select fuel_volume_gallons as y, count(*) as ny from pp where not is_target group by 1) group by 1))""", TEST_CTE),
    "tests_exposure": Query("excess mean_unverified:4 exposure:2", lambda s, d: compare.exposure(period_rows(s, d), interval=False),
        "select *, excess * mean_unverified as exposure from (select cast(trunc((rate_1 - rate_2) * n1) as bigint) as excess, (select avg(transaction_amount) from pp where is_target and not has_eld_activity) as mean_unverified, p_value from te where metric = 'No ELD Match') where p_value < 0.05 and excess > 0", TEST_CTE),
    "tests_exposure_interval": Query("excess exposure:2 exposure_low:2 exposure_high:2", lambda s, d: compare.exposure(period_rows(s, d), CONFIG), ""),
    "tests_magnitudes": Query("metric risk_ratio_band odds_ratio_band risk_difference_band", lambda s, d: compare.magnitudes(compare.proportions(compare.counts(period_rows(s, d)))),
        "select metric, " + ", ".join(f"{stats.band_sql(x, cuts, stats.RATIO_NAMES)} as {n}_band" for n, x, cuts in (("risk_ratio", "greatest(risk_ratio, 1 / nullif(risk_ratio, 0))", CONFIG.effect_sizes.risk_ratio), ("odds_ratio", "greatest(odds_ratio, 1 / nullif(odds_ratio, 0))", CONFIG.effect_sizes.odds_ratio), ("risk_difference", "(rate_1 - rate_2)", CONFIG.effect_sizes.risk_difference))) + " from te", TEST_CTE),
    "tests_log_advice": Query("n skew:5 kurtosis:5 p99_ratio:5 tail_share:6 dispersion_drop:5 advised", lambda s, d: compare.log_advice(target_rows(s, d), "transaction_amount"), _LOG, _LOG_CTE),
    "tests_fisher": Query("metric p:6", lambda s, d: compare.counts(period_rows(s, d)).select("metric", workers.fisher("a", F.col("n1") - F.col("a"), "b", F.col("n2") - F.col("b")).alias("p")), _FISHER, TEST_CTE),
    "tests_bootstrap": Query("low:4 high:4", lambda s, d: workers.bootstrap(target_rows(s, d).where("not has_eld_activity"), "transaction_amount", CONFIG.performance.n_bootstrap), ""),
    "tests_bootstrap_statistics": Query("statistic low:4 high:4", _intervals, ""),
    "tests_vif": Query("feature vif:4", lambda s, d: workers.vif(target_rows(s, d), list(_VIF)), _vif_sql(_VIF)),
    "summary_coverage": Query("slice row_count eld_share:6", lambda s, d: split.in_period(transactions(s, d)).where("in_period").groupBy(F.when(F.col("is_target"), "target").otherwise("peers").alias("slice")).agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.col("has_eld_activity").cast("double")).alias("eld_share")),
        "select case when is_target then 'target' else 'peers' end as slice, count(*) as row_count, avg(cast(has_eld_activity as integer)) as eld_share from px where in_period group by 1"),
    "summary_financial": Query("total_target:2 total_peer:2 target_share:6 mean_difference:4", lambda s, d: compare.cost(period_rows(s, d)).select("total_target", "total_peer", (F.col("total_target") / (F.col("total_target") + F.col("total_peer"))).alias("target_share"), "mean_difference"),
        "select a as total_target, b as total_peer, a / (a + b) as target_share, ma - mb as mean_difference from (select sum(transaction_amount) filter (where is_target) as a, sum(transaction_amount) filter (where not is_target) as b, avg(transaction_amount) filter (where is_target) as ma, avg(transaction_amount) filter (where not is_target) as mb from pp)", TEST_CTE),
    "dashboard_monthly": Query("month branch_group no_eld:1 spend:2 transactions", lambda s, d: transactions(s, d).groupBy("month", "branch_group").agg((100 * F.avg((~F.col("has_eld_activity")).cast("double"))).alias("no_eld"), F.sum("transaction_amount").alias("spend"), F.countDistinct("datetime_parsed").alias("transactions")),
        "select month, branch_group, 100 * avg(cast(not has_eld_activity as integer)) as no_eld, sum(transaction_amount) as spend, count(distinct datetime_parsed) as transactions from tx group by 1, 2"),
    "dashboard_weekly": Query("year week_number branch_group spend:2 moving_average:2", lambda s, d: _weekly(transactions(s, d)),
        "select * from (select *, avg(spend) over (partition by branch_group order by year, week_number rows 3 preceding) as moving_average, row_number() over (partition by branch_group order by year desc, week_number desc) as r from (select year, week_number, branch_group, sum(transaction_amount) as spend from tx group by 1, 2, 3)) where r <= 52"),
    "dashboard_indicators": Query("branch_group no_eld:6 non_diesel:6 after_hours:6", lambda s, d: transactions(s, d).groupBy("branch_group").agg(*[(100 * F.avg((~F.col(c)).cast("double"))).alias(n) for n, c in risk.RATES.items()]),
        "select branch_group, 100 * avg(cast(not has_eld_activity as integer)) as no_eld, 100 * avg(cast(not is_diesel_def as integer)) as non_diesel, 100 * avg(cast(not is_business_hours as integer)) as after_hours from tx group by 1"),
    "dashboard_products": Query("product n", lambda s, d: _top_products(target_rows(s, d)),
        "select case when r <= 4 then product_clean else 'Other' end as product, cast(sum(n) as bigint) as n from (select product_clean, count(*) as n, row_number() over (order by count(*) desc, product_clean) as r from tp group by 1) group by 1"),
}
NO_SQL = {"tests_bootstrap", "tests_bootstrap_statistics", "tests_exposure_interval"}


def _weekly(df):
    """The last 52 weeks of each branch with a four-week moving average."""
    from pyspark.sql.window import Window as W

    w = df.groupBy("year", "week_number", "branch_group").agg(F.sum("transaction_amount").alias("spend"))
    own = W.partitionBy("branch_group")
    w = w.withColumns({"moving_average": F.avg("spend").over(own.orderBy("year", "week_number").rowsBetween(-3, 0)), "_r": F.row_number().over(own.orderBy(F.desc("year"), F.desc("week_number")))})
    return w.where("_r <= 52")


def _top_products(df, n: int = 4):
    """The n most frequent products and the rest as Other."""
    from pyspark.sql.window import Window as W

    p = df.groupBy("product_clean").agg(F.count(F.lit(1)).alias("n")).withColumn("_r", F.row_number().over(W.orderBy(F.desc("n"), "product_clean")))
    return p.groupBy(F.when(F.col("_r") <= n, F.col("product_clean")).otherwise("Other").alias("product")).agg(F.sum("n").alias("n"))

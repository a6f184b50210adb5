"""Queries over monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds, ranks, stats
from ..operators import compare, temporal
from .base import Query, transactions

_ENTITY = "select 'driver' as entity_type, driver_name as entity_id, * from {0} union all select 'vehicle', vehicle_id, * from {0}"
_METRICS = {"datetime_count": "count(distinct datetime_parsed)", "no_eld_rate": "100 * avg(cast(not has_eld_activity as integer))", "non_diesel_rate": "100 * avg(cast(not is_diesel_def as integer))", "after_hours_rate": "100 * avg(cast(not is_business_hours as integer))", "cost_mean": "avg(transaction_amount)", "cost_median": "quantile_cont(transaction_amount, 0.5)", "cost_sum": "sum(transaction_amount)"}


def _monthly(name: str, where: str, rows: int) -> str:
    cols = ", ".join(f"{e} as {c}" for c, e in _METRICS.items())
    return f"""{name} as (select * from (select *, sum(k) over (partition by entity_type, entity_id) as nk, count(*) over (partition by entity_type, entity_id) as nm from (
      select entity_type, entity_id, month, count(*) as k, {cols} from ({_ENTITY.format(f'(select * from tx where {where})')}) where entity_id is not null and entity_id not in ('', 'Unknown') group by 1, 2, 3)) where nk >= {rows} and nm >= 3)"""


def _long(name: str, source: str, metrics) -> str:
    return f"{name} as (" + " union all ".join(f"select entity_type, entity_id, '{c}' as metric, month, cast({c} as double) as value from {source}" for c in metrics) + ")"


_S = "partition by entity_type, entity_id, metric"
CTE = ", ".join([
    _monthly("mt", "is_target", 20), _monthly("mp", "not is_target", 3), _long("ls", "mt", temporal.TRACKED), _long("lp", "mp", temporal.METRICS),
    """base as (select entity_type, metric, count(value) as n, avg(value) as mean, stddev_pop(value) as std, min(value) as minimum, max(value) as maximum, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q75,
       quantile_cont(value, 0.9) as q90, quantile_cont(value, 0.95) as q95, quantile_cont(value, 0.99) as q99 from lp group by 1, 2)""",
    f"lg as (select *, lag(value) over ({_S} order by month) as a, row_number() over ({_S} order by month) as i, count(*) over ({_S}) as n, avg(value) over ({_S}) as mean, stddev_samp(value) over ({_S}) as sd from ls)",
    "ch as (select *, case when a is null then null when a = 0 and value = 0 then 0 when a = 0 then value when value = 0 then -a else (value - a) / a end as change from lg)",
    f"""sp as (select entity_type, entity_id, metric, string_agg(month, ',' order by month) as spike_months, max({stats.normal_cdf_sql('z')} * 100) as highest_percentile from (
       select ch.*, (ch.value - base.mean) / base.std as z from ch join base using (entity_type, metric) where base.std > 0 and ch.n >= 3) where change > 0 and (change > 0.5 or z > 1.645) group by 1, 2, 3)""",
    f"""es as (select entity_type, entity_id, metric, max(run) as longest from (select entity_type, entity_id, metric, isl, count(*) as run from (
       select *, sum(case when change > 0 then 0 else 1 end) over ({_S} order by month) as isl from ch where change is not null) where change > 0 group by 1, 2, 3, 4) group by 1, 2, 3 having max(run) >= 3)""",
    f"""ac as (select entity_type, entity_id, metric, n, acf1, case when acf1 > 0.6 then 'HIGH' when acf1 > 0.4 then 'MEDIUM' else 'LOW' end as risk_level from (
       select entity_type, entity_id, metric, count(*) as n, min(value) as lo, max(value) as hi, sum(d * nx) / nullif(sum(d * d), 0) as acf1 from (
         select *, value - mean as d, lead(value) over ({_S} order by month) - mean as nx from lg) group by 1, 2, 3) where n >= 5 and lo < hi)""",
    f"""mk0 as (select l.entity_type, l.entity_id, l.metric, l.n, coalesce(s, 0) as s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0e0 as vr from (
       select entity_type, entity_id, metric, cast(sum(t) as double) as n, sum(t * (t - 1) * (2 * t + 5)) as ties from (select entity_type, entity_id, metric, value, count(*) as t from ls group by 1, 2, 3, 4) group by 1, 2, 3) l
       left join (select a.entity_type, a.entity_id, a.metric, cast(sum(sign(b.value - a.value)) as double) as s from ls a join ls b on a.entity_type = b.entity_type and a.entity_id = b.entity_id and a.metric = b.metric and a.month < b.month group by 1, 2, 3) p using (entity_type, entity_id, metric))""",
    f"""mk as (select entity_type, entity_id, metric, cast(n as bigint) as n, s, s / nullif(n * (n - 1) / 2, 0) as tau, z, p_value, case when n < 3 then 'insufficient_data' when vr <= 0 then 'no_trend' when p_value < 0.05 and s > 0 then 'increasing' when p_value < 0.05 and s < 0 then 'decreasing' else 'no_trend' end as trend
       from (select *, {stats.two_sided_p_sql('z')} as p_value from (select *, case when vr <= 0 or n < 3 then null else (s - sign(s)) / sqrt(vr) end as z from mk0)))""",
    f"""cz as (select *, (value - mean) / sd as z from lg where sd > 0 and i > 1),
       cs1 as (select *, sum(z - 0.5e0) over ({_S} order by month) as up, sum(z + 0.5e0) over ({_S} order by month) as dn from cz),
       cs2 as (select *, up - least(0, min(up) over ({_S} order by month)) as cp, dn - greatest(0, max(dn) over ({_S} order by month)) as cm from cs1)""",
    "cu as (select entity_type, entity_id, metric, month as change_month, case when cp > 3.5 then 'increase' else 'decrease' end as direction from (select *, row_number() over (partition by entity_type, entity_id, metric order by month) as r from cs2 where cp > 3.5 or cm < -3.5) where r = 1)",
    """fp0 as (select *, row_number() over (partition by entity_type, entity_id order by month) as r, count(*) over (partition by entity_type, entity_id) as n,
       coalesce(lead(datetime_count) over (partition by entity_type, entity_id order by month) > 1.5e0 * datetime_count and lead(datetime_count, 2) over (partition by entity_type, entity_id order by month) < 0.6e0 * lead(datetime_count) over (partition by entity_type, entity_id order by month), false)
       or coalesce(lead(no_eld_rate) over (partition by entity_type, entity_id order by month) > 1.5e0 * no_eld_rate and lead(no_eld_rate, 2) over (partition by entity_type, entity_id order by month) < 0.6e0 * lead(no_eld_rate) over (partition by entity_type, entity_id order by month), false) as sr from mt)""",
    """fp as (select entity_type, entity_id, coalesce(avg(after_hours_rate) filter (where r > n - 3) > 60, false) as off_hours_concentration, bool_or(sr) as spike_and_retreat,
       coalesce(max(n) >= 6 and avg(no_eld_rate) filter (where r > n // 2) > 1.3e0 * avg(no_eld_rate) filter (where r <= n // 2), false) as escalation_by_halves, false as operational_anomaly from fp0 group by 1, 2)""",
    "la as (select * from (select *, row_number() over (partition by entity_type, entity_id order by month desc) as r from mt) where r = 1)",
])
_cnt = lambda t, where, name: f"left join (select entity_type, entity_id, count(*) as {name} from {t} where {where} group by 1, 2) {name}_t using (entity_type, entity_id)"


#: Segmentation: kernel sums of cells of five months, costs of runs of cells, then the optimum over them as a list that grows by one cell a step.
_K = "entity_type, entity_id, metric"
SEGMENTS = CTE + f""",
  sg as materialized (select * from (select {_K}, month, value, row_number() over ({_S} order by month) - 1 as i, count(*) over ({_S}) as n, min(value) over ({_S}) as lo, max(value) over ({_S}) as hi from ls where value is not null) where n >= 6 and lo < hi),
  sgm as materialized (select {_K}, case when med > 0 then 1 / med else 1.0e0 end as g from (select {_K}, quantile_cont((a.value - b.value) * (a.value - b.value), 0.5) as med from sg a join sg b using ({_K}) where a.i < b.i group by all)),
  sgc as materialized (select {_K}, a.n, a.i // 5 as ca, b.i // 5 as cb, sum(case when a.i = b.i then 1.0e0 else exp(-least(greatest(g * (a.value - b.value) * (a.value - b.value), 0.01e0), 100)) end) as k from sg a join sg b using ({_K}) join sgm using ({_K}) group by all),
  sgr as materialized (select {_K}, n, s, e from (select distinct {_K}, n from sgc), unnest(range(0, (n + 4) // 5)) r(s), unnest(range(1, (n + 4) // 5 + 1)) q(e) where s < e and least(5 * e, n) - 5 * s >= 2),
  sgs as materialized (select {_K}, n, s, e, len - sum(k) / len + 2 * ln(n) as cost from (select *, least(5 * e, n) - 5 * s as len from sgr join sgc using ({_K}, n) where ca >= s and cb >= s and ca < e and cb < e) group by {_K}, n, s, e, len),
  dp as (select distinct {_K}, n, 0 as e, [-2 * ln(n)] as f, [-1::bigint] as back from sgc
    union all select d.entity_type, d.entity_id, d.metric, d.n, d.e + 1, list_append(d.f, min(d.f[s.s + 1] + s.cost)), list_append(d.back, arg_min(s.s, d.f[s.s + 1] + s.cost))
      from dp d join sgs s on s.entity_type = d.entity_type and s.entity_id = d.entity_id and s.metric = d.metric and s.e = d.e + 1 group by d.entity_type, d.entity_id, d.metric, d.n, d.e, d.f, d.back),
  bt as (select {_K}, back, back[e + 1] as p from dp where e = (n + 4) // 5 union all select {_K}, back, back[p + 1] from bt where p > 0),
  cps as (select {_K}, coalesce(string_agg(sg.month, ',' order by sg.month), '') as change_points, count(sg.month) as points from (select distinct {_K} from sgc) left join (select {_K}, 5 * p - 1 as i from bt where p > 0) using ({_K}) left join sg using ({_K}, i) group by {_K})"""


def _score_ctes() -> str:
    return SEGMENTS + f""",
  adverse as (select * from mk where case when metric = 'cost_mean' then trend = 'decreasing' else trend = 'increasing' end),
  rolled as (select * from (select *, case when k >= 2 and w > 0 then (value - m) / w end as z from (select *, avg(value) over x as m, stddev_samp(value) over x as w, count(*) over x as k from ls window x as ({_S} order by month rows between 2 preceding and current row))) where abs(z) > 2 and metric <> 'cost_mean'),
  sc0 as (select la.entity_type, la.entity_id, la.month as latest_month, coalesce(trends, 0) as trends, coalesce(changes, 0) as changes, cast(coalesce(pts, 0) as bigint) as points, coalesce(spikes, 0) as spikes, coalesce(escalations, 0) as escalations, coalesce(persistent, 0) as persistent, coalesce(outliers, 0) as outliers,
       cast(off_hours_concentration as integer) + cast(spike_and_retreat as integer) + cast(escalation_by_halves as integer) as patterns,
       (case when no_eld_rate > 20 then 8 else 0 end) + (case when non_diesel_rate > 15 then 6 else 0 end) + (case when after_hours_rate > 25 then 6 else 0 end) as current
     from la left join fp using (entity_type, entity_id) {_cnt('adverse', 'true', 'trends')} {_cnt('cu', 'true', 'changes')} {_cnt('sp', "metric <> 'cost_mean'", 'spikes')} {_cnt('es', "metric <> 'cost_mean'", 'escalations')}
       {_cnt('ac', "risk_level = 'HIGH' and metric in ('no_eld_rate', 'non_diesel_rate', 'after_hours_rate')", 'persistent')} {_cnt('rolled', 'true', 'outliers')}
       left join (select entity_type, entity_id, sum(points) as pts from cps group by 1, 2) using (entity_type, entity_id)),
  sc as (select *, {stats.risk_band_sql('temporal_risk_score')} as risk_band from (select *, cast(least(100, least(20, trends * 10) + least(25, (changes + points) * 8) + least(25, spikes * 12) + least(15, escalations * 8) + least(30, patterns * 15) + least(15, persistent * 8) + least(15, outliers * 5) + current) as bigint) as temporal_risk_score from sc0))"""


SCORE = _score_ctes()
_NAME = "case metric " + " ".join(f"when '{c}' then '{n}'" for c, n in temporal.NAMES.items()) + " end"
_RANK = "list_position(['no_eld_rate', 'non_diesel_rate', 'after_hours_rate', 'datetime_count'], metric)"
INDICATORS = SCORE + f""",
  texts as (
    select entity_type, entity_id, 0 as kind, list_position(['datetime_count', 'no_eld_rate', 'non_diesel_rate', 'after_hours_rate', 'cost_mean'], metric) as rk, case when metric = 'cost_mean' then '{temporal.FALLING_COST}' else 'INCREASING ' || {_NAME} end as txt from adverse
    union all select entity_type, entity_id, 1, {_RANK}, 'SUDDEN SPIKE in ' || {_NAME} || ' (+' || printf('%.0f', highest_percentile) || 'th percentile)' from sp where metric <> 'cost_mean'
    union all select entity_type, entity_id, 2, {_RANK}, 'GRADUAL ESCALATION in ' || {_NAME} || ' (' || longest || ' consecutive months)' from es where metric <> 'cost_mean'
    union all select entity_type, entity_id, 3, {_RANK}, 'ANOMALOUS MONTHS in ' || {_NAME} || ': ' || string_agg(month, ', ' order by month) from rolled group by entity_type, entity_id, metric
    union all select entity_type, entity_id, 4, {_RANK}, 'PERSISTENT PATTERN in ' || {_NAME} || ' (autocorr=' || printf('%.2f', acf1) || ')' from ac where risk_level = 'HIGH' and metric in ('no_eld_rate', 'non_diesel_rate', 'after_hours_rate')
    {' '.join(f"union all select entity_type, entity_id, 5, {i}, '{text}' from fp where {c}" for i, (c, text) in enumerate(temporal.PATTERNS.items()))}),
  now as (select entity_type, entity_id, concat_ws('; ', case when no_eld_rate > 20 then 'High No ELD Rate (' || printf('%.1f', no_eld_rate) || '%)' end, case when non_diesel_rate > 15 then 'High Non-Diesel Rate (' || printf('%.1f', non_diesel_rate) || '%)' end, case when after_hours_rate > 25 then 'High After Hours Rate (' || printf('%.1f', after_hours_rate) || '%)' end) as current_factors,
    cast(no_eld_rate > 20 as integer) + cast(non_diesel_rate > 15 as integer) + cast(after_hours_rate > 25 as integer) as recent_behavior from la),
  vol as (select entity_type, entity_id, sum(v) as volatility from (select c.entity_type, c.entity_id, c.metric, coalesce(stddev_samp(c.change) filter (where abs(c.change) < 5), 0) as v from ch c join base b on b.entity_type = c.entity_type and b.metric = c.metric and b.std > 0 where c.metric <> 'cost_mean' and c.change is not null group by 1, 2, 3) group by 1, 2)"""


#: Scores of the target's drivers and of the peers', the latter from the same tables over the peers' rows.
BOTH = SCORE + f""",
  both_scores as (select cast(temporal_risk_score as double) as v, true as t from sc where entity_type = 'driver'
    union all select v, false from (with recursive {SCORE.replace("from tx where is_target", "from tx where not is_target")} select cast(temporal_risk_score as double) as v from sc where entity_type = 'driver')),
  both_test as (select r.*, (select count(*) = count(distinct v) from both_scores) as "distinct" from ({ranks.rank_test_sql('both_scores', 'v', 't')}) r)"""
_BOTH_STATS = ", ".join(f"avg(v) filter (where {c}) as mean_{i}, " + ", ".join(f"quantile_cont(v, {q}) filter (where {c}) as {n}_{i}" for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))) for i, c in ((1, "t"), (2, "not t")))


def target(s, d):
    return transactions(s, d).where("is_target")


def peers(s, d):
    return transactions(s, d).where("not is_target")


def ser(s, d):
    return temporal.series(target(s, d))


def _scores(s, d):
    mine, others, _ = temporal.branch_months(transactions(s, d))
    return temporal.score_of(mine, others)


def _indicators(s, d):
    mine, others, _ = temporal.branch_months(transactions(s, d))
    return temporal.indicators(mine, others).withColumns({c: F.array_join(c, "; ") for c in ("indicators", "current_factors")})


def _both_scores(s, d):
    mine, others, known = temporal.branch_months(transactions(s, d), types=("driver",))
    a, b = (temporal.score_of(m, others).select("temporal_risk_score", F.lit(t).alias("is_target")) for m, t in ((mine, True), (known, False)))
    return compare.scores(a.unionByName(b), "temporal_risk_score", "is_target")


_HALF = f"select *, i > n // 2 as later from lg where n // 2 >= 3"
QUERIES = {
    "series_monthly": Query("entity_type entity_id month datetime_count no_eld_rate:6 non_diesel_rate:6 after_hours_rate:6 cost_mean:8 cost_median:8 cost_sum:6", lambda s, d: temporal.monthly(target(s, d), 20, 3), "select * from mt", CTE),
    "series_baselines": Query("entity_type metric n mean:4 std:4 minimum:4 maximum:4 q25:4 median:4 q75:4 q90:4 q95:4 q99:4", lambda s, d: temporal.baselines(peers(s, d)), "select * from base", CTE),
    "series_percentiles": Query("entity_type entity_id metric month value:8 z:4 percentile:4", lambda s, d: temporal.against_baseline(ser(s, d), temporal.baselines(peers(s, d))),
        """select *, case when std = 0 then 0 else (value - mean) / std end as z, case when value <= minimum then 0 """ + "".join(f"when value <= {b} then {pa} + coalesce((value - {a}) / nullif({b} - {a}, 0), 0) * {pb - pa} " for (a, pa), (b, pb) in zip([("minimum", 0), ("q25", 25), ("median", 50), ("q75", 75), ("q90", 90), ("q95", 95), ("q99", 99)], [("q25", 25), ("median", 50), ("q75", 75), ("q90", 90), ("q95", 95), ("q99", 99), ("maximum", 100)])) + "else 100 end as percentile from (select ls.*, mean, std, minimum, q25, median, q75, q90, q95, q99, maximum from ls join base using (entity_type, metric))", CTE),
    "series_changes": Query("entity_type entity_id metric month value:8 change:6", lambda s, d: temporal.changes(ser(s, d)), "select * from ch", CTE),
    "series_spikes": Query("entity_type entity_id metric spike_months highest_percentile:4", lambda s, d: temporal.spikes(ser(s, d), temporal.baselines(peers(s, d))), "select * from sp", CTE),
    "series_escalations": Query("entity_type entity_id metric longest", lambda s, d: temporal.escalations(ser(s, d)), "select * from es", CTE),
    "series_volatility": Query("entity_type entity_id volatility:5", lambda s, d: temporal.volatility(ser(s, d)), "select entity_type, entity_id, sum(v) as volatility from (select entity_type, entity_id, metric, coalesce(stddev_samp(change) filter (where abs(change) < 5), 0) as v from ch where change is not null group by 1, 2, 3) group by 1, 2", CTE),
    "series_rolling": Query("entity_type entity_id metric month z:4", lambda s, d: temporal.rolling_outliers(ser(s, d)), f"select * from (select *, case when k >= 2 and w > 0 then (value - m) / w end as z from (select *, avg(value) over x as m, stddev_samp(value) over x as w, count(*) over x as k from ls window x as ({_S} order by month rows between 2 preceding and current row))) where abs(z) > 2", CTE),
    "series_rolling_exclusive": Query("entity_type entity_id metric month z:4", lambda s, d: temporal.rolling_outliers(ser(s, d), exclusive=True), f"select * from (select *, case when k >= 2 and w > 0 then (value - m) / w end as z from (select *, avg(value) over x as m, stddev_samp(value) over x as w, count(*) over x as k from ls window x as ({_S} order by month rows between 3 preceding and 1 preceding))) where abs(z) > 2", CTE),
    "series_autocorrelation": Query("entity_type entity_id metric n acf1:5 risk_level", lambda s, d: temporal.autocorrelation(ser(s, d)), "select * from ac", CTE),
    "series_fraud_patterns": Query("entity_type entity_id off_hours_concentration spike_and_retreat escalation_by_halves operational_anomaly", lambda s, d: temporal.fraud_patterns(temporal.monthly(target(s, d), 20, 3)), "select * from fp", CTE),
    "series_latest": Query("entity_type entity_id month datetime_count no_eld_rate:6", lambda s, d: temporal.latest(temporal.monthly(target(s, d), 20, 3)), "select * from la", CTE),
    "series_mann_kendall": Query("entity_type entity_id metric n s:1 tau:6 z:5 p_value:5 trend", lambda s, d: temporal.mann_kendall(ser(s, d)), "select * from mk", CTE),
    "series_cusum": Query("entity_type entity_id metric change_month direction", lambda s, d: temporal.cusum(ser(s, d), 0.5, 3.5), "select * from cu", CTE),
    "series_halves": Query("entity_type entity_id metric n1 n2 u:1 cliffs_delta:6 p_value:5 median_early:4 median_late:4 direction", lambda s, d: temporal.halves(ser(s, d)),
        f"""select *, case when coalesce(p_value >= 0.05, true) then 'stable' when median_late > median_early then 'higher' when median_late < median_early then 'lower' else 'stable' end as direction from ({ranks.rank_test_sql('hv', 'value', 'later', 'entity_type, entity_id, metric')})
            join (select entity_type, entity_id, metric, quantile_cont(value, 0.5) filter (where not later) as median_early, quantile_cont(value, 0.5) filter (where later) as median_late from hv group by 1, 2, 3) using (entity_type, entity_id, metric)""", CTE + f", hv as ({_HALF})"),
    "series_halves_recent": Query("entity_type entity_id metric n1 n2 u:1 cliffs_delta:6 p_value:5 direction", lambda s, d: temporal.halves(ser(s, d), last=12),
        f"""select *, case when coalesce(p_value >= 0.05, true) then 'stable' when ml > me then 'higher' when ml < me then 'lower' else 'stable' end as direction from ({ranks.exact_sql('rt')})
            join (select entity_type, entity_id, metric, quantile_cont(value, 0.5) filter (where not later) as me, quantile_cont(value, 0.5) filter (where later) as ml from hv group by 1, 2, 3) using (entity_type, entity_id, metric)""",
        CTE + f""", rc as (select entity_type, entity_id, metric, month, value, row_number() over ({_S} order by month) as i, count(*) over ({_S}) as n from (select * from ls qualify row_number() over ({_S} order by month desc) <= 12)),
          hv as (select *, i > n // 2 as later from rc where n // 2 >= 3), rt as (select * from ({ranks.rank_test_sql('hv', 'value', 'later', 'entity_type, entity_id, metric')}) join (select entity_type, entity_id, metric, count(*) = count(distinct value) as "distinct" from hv group by 1, 2, 3) using (entity_type, entity_id, metric))"""),
    "series_score": Query("entity_type entity_id latest_month trends changes points spikes escalations persistent outliers patterns current temporal_risk_score risk_band", _scores, "select * from sc", SCORE),
    "series_score_summary": Query("entity_type entities mean_score:4 median_score:4 critical high with_spikes with_changes with_patterns", lambda s, d: temporal.score_summary(_scores(s, d)),
        "select entity_type, count(*) as entities, avg(temporal_risk_score) as mean_score, quantile_cont(cast(temporal_risk_score as double), 0.5) as median_score, count(*) filter (where risk_band = 'critical') as critical, count(*) filter (where risk_band = 'high') as high, count(*) filter (where spikes > 0) as with_spikes, count(*) filter (where changes > 0) as with_changes, count(*) filter (where patterns > 0) as with_patterns from sc group by rollup (entity_type)", SCORE),
    "series_timeline": Query("month changes is_peak", lambda s, d: temporal.timeline(temporal.cusum(ser(s, d), 0.5, 3.5)), "select change_month as month, count(*) as changes, rank() over (order by count(*) desc) = 1 as is_peak from cu group by 1", CTE),
    "series_timeline_summary": Query("months total early_share:6 late_share:6 clustered", lambda s, d: temporal.timeline_summary(temporal.timeline(temporal.cusum(ser(s, d), 0.5, 3.5))), "select count(*) as months, cast(coalesce(sum(k), 0) as bigint) as total, coalesce(sum(k) filter (where th = 1) / sum(k), 0) as early_share, coalesce(sum(k) filter (where th = 3) / sum(k), 0) as late_share, coalesce(var_samp(k) > avg(k), false) as clustered from (select k, ntile(3) over (order by change_month) as th from (select change_month, count(*) as k from cu group by change_month))", CTE),
    "series_indicators": Query("entity_type entity_id indicators current_factors total_risk_factors total_change_points has_fraud_patterns volatility:5 recent_behavior", _indicators,
        """select sc.entity_type, sc.entity_id, coalesce(string_agg(txt, '; ' order by kind, rk), '') as indicators, now.current_factors, cast(count(txt) as integer) as total_risk_factors, changes + points as total_change_points, patterns > 0 as has_fraud_patterns, coalesce(volatility, 0) as volatility, recent_behavior
           from sc join now using (entity_type, entity_id) left join texts using (entity_type, entity_id) left join vol using (entity_type, entity_id) group by all""", INDICATORS),
    "series_segments": Query("entity_type entity_id metric change_points", lambda s, d: folds.segments(ser(s, d), temporal.SERIES, "month", "value").withColumn("change_points", F.array_join("change_points", ",")), "select * from cps", SEGMENTS),
    "series_score_comparison": Query("n1 n2 u:1 cliffs_delta:6 p_value:5 mean_1:4 mean_2:4 p25_1:4 p25_2:4 median_1:4 median_2:4 p75_1:4 p75_2:4 mean_difference:4 median_difference:4 direction magnitude significant", _both_scores,
        f"""select r.*, q.*, mean_1 - mean_2 as mean_difference, median_1 - median_2 as median_difference, case when abs(cliffs_delta) < 0.15 then 'negligible' when cliffs_delta > 0 then 'higher' else 'lower' end as direction,
            {stats.band_sql('cliffs_delta', (0.147, 0.33, 0.474), stats.CLIFF_NAMES)} as magnitude, p_value < 0.05 as significant from ({ranks.exact_sql('both_test')}) r, (select {_BOTH_STATS} from both_scores) q where n1 >= 3 and n2 >= 3""", BOTH),
}
NO_SQL: set[str] = set()

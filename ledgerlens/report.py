"""The text report: fixed-width tables over the small frames that the operators return, in a fixed order."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .operators import compare, patterns, quality, risk, split, temporal

MISSING_LIKE = {"", "N/A", "NA", "NULL", "NONE", "NAN", "INF", "-INF", "NAT"}


def is_missing(x) -> bool:
    """None, NaN, infinities, blanks and words that stand for nothing; booleans never."""
    if isinstance(x, bool):
        return False
    if x is None or (isinstance(x, float) and (x != x or x in (float("inf"), float("-inf")))):
        return True
    return isinstance(x, str) and x.strip().upper() in MISSING_LIKE


def currency(x) -> str:
    return "N/A" if is_missing(x) else f"-${-x:,.2f}" if x < 0 else f"${x:,.2f}"


def percent(x, digits: int = 1) -> str:
    """A share of 1 as a percentage."""
    return "N/A" if is_missing(x) else f"{100 * x:.{digits}f}%"


def p_value(x) -> str:
    return "N/A" if is_missing(x) else "<0.001" if x < 0.001 else f"{x:.3f}"


def number(x, digits: int = 2) -> str:
    return "N/A" if is_missing(x) else f"{x:,.{digits}f}"


def day(x) -> str:
    """A date or time as 2024-01-31."""
    return "N/A" if is_missing(x) else f"{x:%Y-%m-%d}"


def interval(low, high, show=number) -> str:
    """Both bounds of an interval in one form; N/A if one is missing."""
    return "N/A" if is_missing(low) or is_missing(high) else f"[{show(low)}, {show(high)}]"


def counted(n: int, one: str, many: str) -> str:
    return f"{n:,} {one if n == 1 else many}"


def entities_by_metric(rows: Sequence[Mapping], month: str, empty: str = "", brackets: bool = True, ordered: bool = True) -> str:
    """The entities of a month by metric, as ``cost_mean: [a, b]; no_eld_rate: [c]``; each once, empty text for an unknown month.

    rows hold month, metric and entities, a list or None.
    """
    out = []
    for r in rows:
        if r["month"] == month:
            names = list(dict.fromkeys(map(str, r["entities"] or ())))
            names = ", ".join(sorted(names) if ordered else names)
            out.append(f"{r['metric']}: " + (f"[{names}]" if names and brackets else names or empty))
    return "; ".join(out)


def _as_number(x):
    """A text that writes a number, with thousands or as a percentage, as that number; anything else as it is."""
    if not isinstance(x, str) or is_missing(x):
        return x
    plain = x.strip().replace(",", "").removeprefix("$")
    try:
        return float(plain[:-1]) / 100 if plain.endswith("%") else float(plain)
    except ValueError:
        return x


class _Filler(Formatter):
    def get_value(self, key, args, kwargs):
        return kwargs.get(key, f"{{MISSING:{key}}}") if isinstance(key, str) else super().get_value(key, args, kwargs)

    def format_field(self, value, spec):
        if spec[-1:] not in tuple("bcdeEfFgGnoxX%"):
            return super().format_field("" if value is None else value, spec)
        try:
            return format(_as_number(value), spec)
        except (ValueError, TypeError):  # a number's form on text: the text, as wide and on the same side
            side = re.match(r"(.?[<>^])?0?(\d*)", spec)
            return format("N/A" if value is None else str(value), (side[1] or "") + side[2])


def fill(template: str, values: Mapping) -> str:
    """A template with its values; a missing one shows as {MISSING:name}, and a number format reads numbers in texts or leaves the text."""
    return _Filler().vformat(template, (), values)


def table(rows: Sequence[Mapping], columns: Mapping[str, str], width: int = 100) -> str:
    """Rows as a fixed-width table; columns maps names to headings."""
    cells = [[h for h in columns.values()]] + [["N/A" if is_missing(r[c]) else f"{r[c]:,.2f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    wide = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(row, wide))[:width].rstrip() for row in cells]
    return "\n".join([lines[0], "-" * min(width, len(lines[0])), *(lines[1:] or ["(none)"])])


def _rows(df: DataFrame, n: int = 10) -> list[dict]:
    """At most n rows: reports show the top of frames that are sorted or small."""
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]


def methodology(config: Config) -> str:
    """What the tests are and which settings they use."""
    e = config.effect_sizes
    return "\n".join([
        f"Significance: two-sided, alpha {config.statistics.alpha:g}, intervals at {config.statistics.confidence:.0%}.",
        "Rates: pooled two-proportion z test, risk and odds ratios with log-normal intervals, Wilson intervals.",
        "Costs: Mann-Whitney U with tie and continuity corrections, Cliff's delta as effect.",
        f"Cliff's delta is negligible below {e.cliff[0]}, small below {e.cliff[1]}, medium below {e.cliff[2]}; Cohen's d below {', '.join(map(str, e.cohen))}.",
        "Several tests: false-discovery rate by Benjamini and Hochberg over the family of key metrics.",
        "Transactions are taken as independent; repeated visits of one driver are not modelled.",
    ])


def narrative(tests: Sequence[Mapping], exposed: Sequence[Mapping]) -> str:
    """The significant tests in sentences, the strongest first, and the exposure they amount to."""
    out = []
    for t in tests:
        how = "higher" if (t["effect"] or 0) > 0 or (t["statistic"] or 0) > 0 else "lower"
        if t["rejected"]:
            out.append(fill("- {metric} is {how} than at peers (p {p}, q {q}).", {"metric": t["metric"], "how": how, "p": p_value(t["p_value"]), "q": p_value(t["q_value"])}))
    for x in exposed:
        bounds = interval(x["exposure_low"], x["exposure_high"], currency)
        out.append(f"- {counted(x['excess'], 'transaction', 'transactions')} beyond the peers' rate lack telemetry: {currency(x['exposure'])} {bounds}.")
    return "\n".join(out) or "No significant difference."


def report(df: DataFrame, config: Config = Config(), prepared: Mapping | None = None) -> str:
    """All sections over enriched transactions with in_period; prepared is the row of ``clean.counts``, if at hand."""
    now, n = df.where("in_period"), config.output.top_n
    mine = now.where("is_target")
    width = config.output.width
    out = [f"{'=' * width}\nFORENSIC TRANSACTION REPORT: {config.target.name}\n{'=' * width}"]

    def section(title: str, text: str):
        out.append(f"{title.upper()}\n{text}")

    section("scope", table(_rows(split.scope(now)), {"row_count": "transactions", "peer_locations": "peer locations", "first_time": "from", "last_time": "to"}))
    if prepared:
        section("preparation", "\n".join(f"{k}: {number(prepared[k], 0)}" for k in ("initial", "duplicates", "incomplete", "final")))
    section("period", _rows(split.label(now))[0]["period"] or "N/A")
    section("slices", table(_rows(split.slice_counts(df)), {"slice": "slice", "row_count": "transactions"}))
    section("methodology", methodology(config))
    lacks = quality.missing(now.select("driver_name", "distance_miles", "merchant_name", "transaction_amount")).orderBy(F.desc("fraction"))
    section("data quality", table(_rows(lacks, 5), {"column_name": "column", "missing": "missing", "fraction": "fraction"}))
    for t in _rows(compare.magnitudes(compare.proportions(compare.counts(now), config.statistics.alpha), config)):
        section(f"test: {t['metric']}", "\n".join([
            f"target {percent(t['rate_1'])} of {number(t['n1'], 0)}, peers {percent(t['rate_2'])} of {number(t['n2'], 0)}",
            f"difference {interval(t['difference_low'], t['difference_high'], percent)} ({t['risk_difference_band']})",
            f"risk ratio {number(t['risk_ratio'])} {interval(t['risk_ratio_low'], t['risk_ratio_high'])} ({t['risk_ratio_band']})",
            f"odds ratio {number(t['odds_ratio'])} {interval(t['odds_ratio_low'], t['odds_ratio_high'])} ({t['odds_ratio_band']})",
            f"z {number(t['z'])}, p {p_value(t['p_value'])}, Cramer's V {number(t['cramers_v'])}",
        ]))
    for t in _rows(compare.cost(now, config)):
        section("test: cost distribution", "\n".join([
            f"median {currency(t['median_target'])} {interval(t['p25_target'], t['p75_target'], currency)} against {currency(t['median_peer'])} {interval(t['p25_peer'], t['p75_peer'], currency)}",
            f"U {number(t['u'], 0)}, p {p_value(t['p_value'])}, Cliff's delta {number(t['cliffs_delta'])} ({t['magnitude']}, {t['direction']})",
        ]))
    tests = _rows(compare.family(now, config).orderBy("p_value", "metric"))
    headings = {"metric": "metric", "statistic": "statistic", "effect": "effect", "p_value": "p", "q_value": "q", "rejected": "significant"}
    section("tests, false-discovery rate", table([t | {"p_value": p_value(t["p_value"]), "q_value": p_value(t["q_value"])} for t in tests], headings))
    exposed = _rows(compare.exposure(now, config))
    section("financial impact", table(exposed, {"excess": "excess transactions", "mean_unverified": "mean amount", "exposure": "exposure", "exposure_low": "from", "exposure_high": "to"}))
    drivers = risk.top(risk.profile(mine, config=config), "composite_risk_score", "driver_name", n)
    section("driver risk", table(_rows(drivers, n), {"driver_name": "driver", "composite_risk_score": "score", "risk_band": "band", "no_eld_rate": "no ELD", "non_diesel_rate": "non-diesel", "after_hours_rate": "after hours"}))
    advice = _rows(compare.log_advice(risk.rates(risk.metrics(mine)), "avg_cost_per_transaction"))[0]
    section("driver costs", f"skewness {number(advice['skew'])}, logarithm {'advised' if advice['advised'] else 'not advised'}; ranks are the same under it")
    vehicles = risk.top(risk.vehicles(mine, config), "composite_risk_score", "vehicle_id", n)
    section("vehicle risk", table(_rows(vehicles, n), {"vehicle_id": "vehicle", "primary_driver": "driver", "composite_risk_score": "score", "risk_band": "band"}))
    section("focused drivers", table(_rows(risk.deep_dive(mine, config)), {"driver_name": "driver", "vehicles": "vehicles", "multi_days": "multi-fill-up days", "max_fillups": "most in a day", "main_product": "main product"}))
    flagged = patterns.red_flags(patterns.day_patterns(mine), config.red_flags)
    days = flagged.orderBy(F.desc("suspicion_score"), "driver_name", "date_only")
    section("multi-fill-up days", table(_rows(days, n), {"driver_name": "driver", "date_only": "day", "fillup_count": "fill-ups", "red_flags": "flags", "suspicion_score": "score"}))
    section("stations", table(_rows(patterns.suspicious_stations(mine, config.red_flags, n)), {"merchant_name": "station", "transaction_count": "transactions", "suspicion_flags": "flags"}))
    months, others, _ = temporal.branch_months(df, config)
    scores = temporal.score_of(months, others, config)
    section("temporal risk", table(_rows(scores.orderBy(F.desc("temporal_risk_score"), "entity_id"), n), {"entity_type": "type", "entity_id": "entity", "temporal_risk_score": "score", "risk_band": "band", "trends": "trends", "changes": "changes", "spikes": "spikes", "escalations": "escalations", "patterns": "patterns"}))
    found = temporal.cusum(temporal.long(months), config.temporal.cusum_k, config.temporal.cusum_h)
    peaks = _rows(temporal.timeline(found).where("is_peak").orderBy("month"), 3)
    at = found.where(F.col("change_month").isin([p["month"] for p in peaks])).groupBy(F.col("change_month").alias("month"), "metric")
    named = _rows(at.agg(F.slice(F.array_sort(F.collect_set("entity_id")), 1, n).alias("entities")).orderBy("month", "metric"), 10 * n)
    section("change points", "\n".join(f"{p['month']}: {counted(p['changes'], 'series', 'series')}; {entities_by_metric(named, p['month'])}" for p in peaks) or "(none)")
    section("summary", narrative(tests, exposed))
    return "\n\n".join(out) + "\n"

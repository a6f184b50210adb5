"""Statistical tests as column expressions over counts and moments, and the same as SQL text for the oracle.

A proportion test needs four counts, which one grouped pass gives; everything here is
arithmetic on them.
"""

from __future__ import annotations

from statistics import NormalDist

#: Chebyshev coefficients of the complementary error function, lowest order first (fixed values; relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def z_of(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def erfc_sql(x: str) -> str:
    """Text that Spark and DuckDB both take, so that p-values agree."""
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * abs({x})))"
    poly = f"{ERFC[-1]!r}e0"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(case when ({x}) >= 0 then {tail} else 2.0e0 - {tail} end)"


def two_sided_p_sql(z: str) -> str:
    return erfc_sql(f"(abs({z}) / sqrt(2.0e0))")


def normal_cdf_sql(z: str) -> str:
    return f"(0.5e0 * {erfc_sql(f'(-({z}) / sqrt(2.0e0))')})"


def wilson_sql(k: str, n: str, alpha: float = 0.05) -> tuple[str, str]:
    """Lower and upper bound; null without observations."""
    z = z_of(alpha)
    p = f"(cast({k} as double) / nullif({n}, 0))"
    mid = f"(({p} + {z * z!r}e0 / (2 * nullif({n}, 0))) / (1 + {z * z!r}e0 / nullif({n}, 0)))"
    half = f"({z!r}e0 * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z * z!r}e0 / (4.0e0 * nullif({n}, 0) * {n})) / (1 + {z * z!r}e0 / nullif({n}, 0)))"
    clamp = lambda x: f"case when {n} > 0 then greatest(0.0e0, least(1.0e0, {x})) end"
    return clamp(f"{mid} - {half}"), clamp(f"{mid} + {half}")


def two_by_two_sql(a: str, n1: str, b: str, n2: str, alpha: float = 0.05, continuity: bool = False) -> dict[str, str]:
    """Tests of a of n1 against b of n2. Null where a test is undefined.

    risk_ratio, odds_ratio with log-normal intervals (half a count added if any cell is
    empty), z and p_value of the pooled two-proportion test (p_value names the column z, so it
    is selected over the others and the long polynomial doesn't repeat what z is made of), chi2 with the continuity
    correction and Cramer's V, Newcombe-style bounds of the difference.
    """
    z = f"{z_of(alpha)!r}e0"
    c, d = f"({n1} - {a})", f"({n2} - {b})"
    ok = f"({n1} > 0 and {n2} > 0)"
    add = f"(case when {a} = 0 or {b} = 0 or {c} = 0 or {d} = 0 then 0.5e0 else 0.0e0 end)"
    ra, rb, rc, rd = (f"({x} + {add})" for x in (a, b, c, d))
    m1, m2 = f"({n1} + 2 * {add})", f"({n2} + 2 * {add})"
    rr = f"(({ra} / nullif({m1}, 0)) / nullif({rb} / nullif({m2}, 0), 0))"
    rse = f"sqrt(1 / nullif({ra}, 0) - 1 / nullif({m1}, 0) + 1 / nullif({rb}, 0) - 1 / nullif({m2}, 0))"
    orr = f"(({ra} * {rd}) / nullif({rb} * {rc}, 0))"
    ose = f"sqrt(1 / nullif({ra}, 0) + 1 / nullif({rb}, 0) + 1 / nullif({rc}, 0) + 1 / nullif({rd}, 0))"
    p1, p2 = f"(cast({a} as double) / nullif({n1}, 0))", f"(cast({b} as double) / nullif({n2}, 0))"
    pool = f"(cast({a} + {b} as double) / nullif({n1} + {n2}, 0))"
    shift = f"least(abs({p1} - {p2}), 0.5e0 * (1.0e0 / nullif({n1}, 0) + 1.0e0 / nullif({n2}, 0)))" if continuity else "0.0e0"
    sign = f"(case when {p1} < {p2} then -1 else 1 end)"
    zs = f"({sign} * (abs({p1} - {p2}) - {shift}) / nullif(sqrt({pool} * (1 - {pool}) * (1.0e0 / nullif({n1}, 0) + 1.0e0 / nullif({n2}, 0))), 0))"
    flat = f"({a} + {b} = 0 or {a} + {b} = {n1} + {n2})"
    n = f"cast({n1} + {n2} as double)"
    det = f"abs(cast({a} as double) * {d} - cast({b} as double) * {c})"
    rows = f"nullif(cast({n1} as double) * {n2} * ({a} + {b}) * ({c} + {d}), 0)"
    chi = f"({n} * power(greatest(0.0e0, {det} - {n} / 2), 2) / {rows})"
    (l1, u1), (l2, u2) = wilson_sql(a, n1, alpha), wilson_sql(b, n2, alpha)
    when = lambda x: f"case when {ok} then {x} end"
    return {
        "rate_1": p1,
        "rate_2": p2,
        "risk_ratio": when(rr),
        "risk_ratio_low": when(f"exp(ln({rr}) - {z} * {rse})"),
        "risk_ratio_high": when(f"exp(ln({rr}) + {z} * {rse})"),
        "odds_ratio": when(orr),
        "odds_ratio_low": when(f"exp(ln({orr}) - {z} * {ose})"),
        "odds_ratio_high": when(f"exp(ln({orr}) + {z} * {ose})"),
        "z": when(f"(case when {flat} then 0.0e0 else {zs} end)"),
        "p_value": when(f"(case when {flat} then (case when {p1} = {p2} then 1.0e0 else 0.0e0 end) else {two_sided_p_sql('z')} end)"),
        "chi2": when(chi),
        "cramers_v": when(f"sqrt({chi} / {n})"),
        "difference_low": f"({l1}) - ({u2})",
        "difference_high": f"({u1}) - ({l2})",
    }


def band_sql(x: str, cuts: tuple[float, ...], names: tuple[str, ...]) -> str:
    """The name of the first cut that |x| is below, else the last name; null for null."""
    return "case when {0} is null then null ".format(x) + "".join(f"when abs({x}) < {c!r}e0 then '{n}' " for c, n in zip(cuts, names)) + f"else '{names[-1]}' end"


def p_band_sql(p: str) -> str:
    return f"case when {p} is null then null when {p} < 0.001e0 then 'p < 0.001' when {p} < 0.01e0 then 'p < 0.01' when {p} < 0.05e0 then 'p < 0.05' else 'not significant' end"


def risk_band_sql(x: str, bands: tuple[float, ...] = (75.0, 50.0, 25.0)) -> str:
    return f"case when {x} is null or {x} < 0 or {x} > 100 then null when {x} >= {bands[0]!r}e0 then 'critical' when {x} >= {bands[1]!r}e0 then 'high' when {x} >= {bands[2]!r}e0 then 'medium' else 'low' end"


CLIFF_NAMES = ("negligible", "small", "medium", "large")
RATIO_NAMES = ("small", "medium", "large")

"""Settings: frozen dataclasses with their checks, and a YAML loader. They live on the driver and end up as literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

import yaml


class ConfigError(ValueError):
    """A setting that is missing, unknown or out of its range."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class BusinessHours:
    start_hour: int = 6
    end_hour: int = 16
    business_days: tuple[int, ...] = (0, 1, 2, 3, 4)

    def __post_init__(self):
        _need(0 <= self.start_hour <= 23 and 0 <= self.end_hour <= 23, "hours must be 0 to 23")
        _need(self.start_hour != self.end_hour, "business hours must not start and end at one hour")
        _need(all(0 <= d <= 6 for d in self.business_days), "days must be 0 (Monday) to 6")


@dataclass(frozen=True)
class Statistics:
    confidence: float = 0.95
    p_value: tuple[float, ...] = (0.05, 0.01, 0.001)

    def __post_init__(self):
        _need(0 < self.confidence < 1, "confidence must be between 0 and 1")
        _need(list(self.p_value) == sorted(self.p_value, reverse=True), "p-value bands must descend")

    @property
    def alpha(self) -> float:
        return round(1 - self.confidence, 12)


@dataclass(frozen=True)
class DataRequirements:
    monthend_days: int = 5
    min_risk_transactions: int = 10
    min_temporal_transactions: int = 20
    min_months: int = 3
    min_current_year_months: int = 3

    def __post_init__(self):
        _need(self.min_temporal_transactions >= self.min_risk_transactions, "temporal analysis needs at least as many transactions as risk analysis")
        _need(self.monthend_days >= 0, "days must not be negative")


@dataclass(frozen=True)
class RiskWeights:
    no_eld: float = 0.30
    non_diesel: float = 0.25
    after_hours: float = 0.25
    cost: float = 0.20

    def __post_init__(self):
        _need(abs(self.no_eld + self.non_diesel + self.after_hours + self.cost - 1) <= 1e-12, "risk weights must add up to 1")


@dataclass(frozen=True)
class Thresholds:
    bands: tuple[float, ...] = (75.0, 50.0, 25.0)
    high_no_eld: float = 0.20
    high_non_diesel: float = 0.15
    high_after_hours: float = 0.25

    def __post_init__(self):
        _need(all(a > b for a, b in zip(self.bands, self.bands[1:])), "risk bands must descend")


@dataclass(frozen=True)
class EffectSizes:
    cliff: tuple[float, ...] = (0.147, 0.33, 0.474)
    cohen: tuple[float, ...] = (0.2, 0.5, 0.8)
    risk_ratio: tuple[float, ...] = (2.0, 3.0)
    odds_ratio: tuple[float, ...] = (3.0, 10.0)
    risk_difference: tuple[float, ...] = (0.10, 0.20)


@dataclass(frozen=True)
class RedFlags:
    passenger_weight: int = 2
    misuse_weight: int = 1
    low_quantile: float = 0.25
    non_diesel_rate: float = 0.5
    many_fillups: int = 4
    rapid_fillups: int = 3
    rapid_hours: float = 1.0
    station_high_quantile: float = 0.75
    station_min_count: int = 5

    def __post_init__(self):
        _need(self.passenger_weight > 0 or self.misuse_weight > 0, "one red-flag weight must be above 0")


@dataclass(frozen=True)
class Temporal:
    spike_change: float = 0.5
    spike_z: float = 1.645
    escalation_months: int = 3
    volatility_cap: float = 5.0
    rolling_window: int = 3
    rolling_z: float = 2.0
    acf_min: int = 5
    acf_high: float = 0.6
    acf_medium: float = 0.4
    off_hours: float = 60.0
    spike_factor: float = 1.5
    retreat_factor: float = 0.6
    halves_factor: float = 1.3
    halves_months: int = 6
    cusum_k: float = 0.5
    cusum_h: float = 3.5


@dataclass(frozen=True)
class Target:
    location: int = 4
    name: str = "Target"

    def __post_init__(self):
        _need(self.location >= 0, "the target's location must not be negative")


@dataclass(frozen=True)
class Output:
    top_n: int = 10
    auto_analyze: int = 3
    width: int = 100

    def __post_init__(self):
        _need(0 < self.auto_analyze <= self.top_n, "auto_analyze must be 1 to top_n")


@dataclass(frozen=True)
class Performance:
    n_bootstrap: int = 10_000

    def __post_init__(self):
        _need(self.n_bootstrap >= 500, "at least 500 resamples")


@dataclass(frozen=True)
class Sources:
    """One merged file, or fuel and telemetry files to be joined."""

    merged: str | None = None
    fuel: str | None = None
    telemetry: str | None = None

    def __post_init__(self):
        _need(not (self.merged and (self.fuel or self.telemetry)), "give a merged file or two to merge, not both")
        _need(bool(self.fuel) == bool(self.telemetry), "fuel and telemetry files go together")

    @property
    def requires_merge(self) -> bool:
        return self.fuel is not None


@dataclass(frozen=True)
class Config:
    business_hours: BusinessHours = field(default_factory=BusinessHours)
    statistics: Statistics = field(default_factory=Statistics)
    data_requirements: DataRequirements = field(default_factory=DataRequirements)
    risk_weights: RiskWeights = field(default_factory=RiskWeights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    effect_sizes: EffectSizes = field(default_factory=EffectSizes)
    red_flags: RedFlags = field(default_factory=RedFlags)
    temporal: Temporal = field(default_factory=Temporal)
    target: Target = field(default_factory=Target)
    output: Output = field(default_factory=Output)
    performance: Performance = field(default_factory=Performance)
    sources: Sources = field(default_factory=Sources)
    columns: dict[str, str] = field(default_factory=dict)  # the user's names by canonical name


#: Other spellings of keys that configuration files may use.
SPELLINGS = {"risk_thresholds": "bands", "risk_score_thresholds": "bands", "p_value_thresholds": "p_value"}


def build(kind: type, values: dict[str, Any], where: str = "") -> Any:
    hints, out = get_type_hints(kind), {}
    names = {f.name for f in fields(kind)}
    for key, value in values.items():
        key = key if key in names else SPELLINGS.get(key, key)
        _need(key in names, f"unknown setting {where}{key}")
        if is_dataclass(hints[key]):
            _need(isinstance(value, dict), f"{where}{key} must be a mapping")
            value = build(hints[key], value, f"{where}{key}.")
        elif isinstance(value, list):
            value = tuple(value)
        elif isinstance(value, dict) and key == "bands":
            value = tuple(value.values())
        out[key] = value
    return kind(**out)


def from_yaml_string(text: str) -> Config:
    """Settings from YAML; what it leaves out has its default."""
    try:
        values = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"malformed YAML: {e}") from e
    _need(isinstance(values, dict) and bool(values) and all(isinstance(k, str) for k in values), "the root must be a mapping with text keys that isn't empty")
    return build(Config, values)


def from_yaml(path: str | Path) -> Config:
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(path)
    return from_yaml_string(path.read_text())

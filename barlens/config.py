"""Parameters of the operators, with their checks, and runtime settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import cache
from pathlib import Path


def _positive(owner: object, *names: str) -> None:
    for name in names:
        if getattr(owner, name) <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class TrendPeriods:
    """Lengths in bars: of the three moving averages, of the month that the long one must rise over, of a year."""

    short: int
    medium: int
    long: int
    month: int
    year: int

    def __post_init__(self) -> None:
        _positive(self, "short", "medium", "long", "month", "year")


# Periods and thresholds of the eight criteria.
PERIODS = {"daily": TrendPeriods(50, 150, 200, 21, 252), "weekly": TrendPeriods(10, 30, 40, 4, 52)}


@dataclass(frozen=True)
class Trend:
    periods: Mapping[str, TrendPeriods] = field(default_factory=lambda: dict(PERIODS))
    least_gain_from_low: float = 0.25
    most_decline_from_high: float = 0.25
    least_rating: int = 70
    gate_passes: int = 6

    def __post_init__(self) -> None:
        if self.least_gain_from_low < 0:
            raise ValueError("the gain from the yearly low must not be negative")
        if not 0 <= self.most_decline_from_high < 1:
            raise ValueError("the decline from the yearly high must be from 0 to under 1")

    def of(self, timeframe: str) -> TrendPeriods:
        if timeframe not in self.periods:
            raise ValueError(f"timeframe must be one of {sorted(self.periods)}")
        return self.periods[timeframe]


@dataclass(frozen=True)
class Stage:
    least_passes: int = 6
    flat_slope: float = 0.02
    extended: float = 0.20


@dataclass(frozen=True)
class Strength:
    """Lookbacks in market sessions with their weights. positive: closes of zero or less are left out; else they count,
    and what is divided by zero is infinite or not a number."""

    lookbacks: tuple[tuple[int, float], ...] = ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2))
    pad_gaps: bool = True
    positive: bool = True

    def __post_init__(self) -> None:
        if any(k <= 0 for k, _ in self.lookbacks):
            raise ValueError("lookbacks must be positive")
        if abs(sum(w for _, w in self.lookbacks) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class Contraction:
    lookback_weeks: int = 65
    swing_window: int = 2
    min_contractions: int = 2
    max_contractions: int = 4
    tolerance: float = 0.80
    volume_min: float = 0.40
    volume_max: float = 0.60
    base_min_weeks: int = 5
    base_max_weeks: int = 65
    daily_lookback: int = 10
    tight_tolerance: float = 0.015
    least_tight_closes: int = 3
    pivot_proximity: float = 0.05
    breakout_lookback: int = 20
    breakout_multiple: float = 1.40
    positive: bool = True  # bars with a price of zero are left out


@dataclass(frozen=True)
class Volume:
    up_down_sessions: int = 50
    distribution_sessions: int = 50
    spike_sessions: int = 10
    spike_proximity: float = 0.05
    spike_average_sessions: int = 20
    spike_multiple: float = 1.40
    positive: bool = True  # bars with a price of zero are left out


@dataclass(frozen=True)
class Moves:
    """Bars of a block, and from how many median absolute deviations and what logarithmic move on a move is far out."""

    block: int = 63
    deviations: float = 8.0
    least: float = 0.10

    def __post_init__(self) -> None:
        _positive(self, "deviations", "least")
        if self.block < 3:
            raise ValueError("a block has three bars at least")


@dataclass(frozen=True)
class Score:
    weights: Mapping[str, float] = field(
        default_factory=lambda: {"trend": 0.25, "stage": 0.10, "strength": 0.20, "contraction": 0.30, "volume": 0.05, "fundamentals": 0.0}
    )
    stage_scores: Mapping[int, float] = field(default_factory=lambda: {1: 50.0, 2: 100.0, 3: 25.0, 4: 0.0})
    gate_passes: int = 6
    gate_rating: int = 70
    new_high_bonus: float = 5.0
    structure_weight: float = 0.70
    confirmation_weight: float = 0.30
    ratio_floor: float = 0.5
    ratio_ceiling: float = 2.0
    accumulation_bonus: float = 15.0
    spike_bonus: float = 15.0


@dataclass(frozen=True)
class Provider:
    api_key: str | None = None
    access_token: str | None = None
    api_secret: str | None = None
    client_id: str | None = None
    max_historical_days: int = 1900
    request_delay_seconds: float = 0.4
    max_retries: int = 3

    @property
    def configured(self) -> bool:
        return bool((self.api_key or self.client_id) and self.access_token)


@dataclass(frozen=True)
class Fundamentals:
    primary_source: str = "screener"
    fallback_source: str = "none"
    cross_check_enabled: bool = True
    cross_check_sample_pct: float = 0.10
    backlog_lag_days: int = 180
    quarter_lag_days: int = 45
    annual_lag_days: int = 60


@dataclass(frozen=True)
class Settings:
    data_provider: str = "kite"
    data_directory: Path = Path("data")
    universe_scope: str = "nifty500"
    constituents_url: str = "https://www.niftyindices.com/IndexConstituent/ind_nifty500list.csv"
    custom_universe_path: Path | None = None
    kite: Provider = field(default_factory=Provider)
    dhan: Provider = field(default_factory=Provider)
    upstox: Provider = field(default_factory=Provider)
    fundamentals: Fundamentals = field(default_factory=Fundamentals)

    def __post_init__(self) -> None:
        for name, allowed in (("data_provider", ("kite", "dhan", "upstox")), ("universe_scope", ("nifty500", "full_nse", "custom"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")

    @property
    def provider_configured(self) -> bool:
        """Whether the selected provider has its credentials."""
        return getattr(self, self.data_provider).configured


def _filled(owner, values: Mapping[str, str], prefix: str = ""):
    """owner with the values named by its fields, nested ones joined by two underscores."""
    changes = {}
    for f in fields(owner):
        now = getattr(owner, f.name)
        key = f"{prefix}{f.name}".upper()
        if is_dataclass(now):
            changes[f.name] = _filled(now, values, f"{prefix}{f.name}__")
        elif key in values:
            raw = values[key]
            if isinstance(now, bool):
                changes[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(now, int | float):
                changes[f.name] = type(now)(raw)
            elif isinstance(now, Path) or f.name.endswith("_path"):
                changes[f.name] = Path(raw)
            else:
                changes[f.name] = raw
    return replace(owner, **changes)


def load_settings(environ: Mapping[str, str] | None = None, env_file: str | Path | None = ".env") -> Settings:
    """Defaults, overridden by the lines NAME=value of env_file if it is there, and those by the environment."""
    values: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, found, value = line.strip().partition("=")
            if found and not name.startswith("#"):
                values[name.strip().upper()] = value.strip().strip("\"'")
    values |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    return _filled(Settings(), values)


@cache
def get_settings() -> Settings:
    """One Settings for each process."""
    return load_settings()

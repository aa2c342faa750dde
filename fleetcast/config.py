"""Run settings and the fixed names shared by every module."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Granularities and what follows from them.
GRANULARITIES = ("month", "day", "week")
DEFAULT_SEASON = {"month": 12, "day": 7, "week": 52}
MIN_SPAN_DAYS = {"month": 366, "day": 7, "week": 7}
MIN_TRAIN_DAYS = {"month": 365, "day": 7, "week": 7}
FIRST_FORECAST_ROW = {"month": 13, "day": 8, "week": 8}
LAST_TRAIN_ROW = {"month": 12, "day": 7, "week": 7}

# Unit names, report labels and decimals.
UNIT_LABELS = {"Euro": "in €", "Stückzahl": "in Stk", "einheitslos": ""}
UNIT_DECIMALS = {"Euro": 2, "Stückzahl": 0, "einheitslos": 9}

# Method names as they appear in forecasts and reports.
HOLT_WINTERS = "Holt Winters"
LASSO = "Lasso"
MLR = "Multiple lineare Regression"
RIDGE = "Ridge"
ELASTIC_NET = "ElasticNet"
SARIMA = "SARIMA"
SARIMAX = "SARIMAX"
RANDOM_FOREST = "XGB Random Forest"
BOOSTING = "Gradient Boosting XGB"
METHODS = (HOLT_WINTERS, LASSO, MLR, RIDGE, ELASTIC_NET, SARIMA, SARIMAX, RANDOM_FOREST, BOOSTING)

OUTLIER_Z = 3.0
STRONG_CORRELATION = 0.6


@dataclass(frozen=True)
class ForecastConfig:
    """Settings of one run; every series of the fleet shares them."""

    train_start: date
    forecast_start: date
    horizon: int
    granularity: str = "month"
    season: int | None = None
    unit: str = "einheitslos"
    drivers: tuple[str, ...] = ()
    methods: tuple[str, ...] = METHODS
    run_name: str = "forecast"
    criterion: str = "aic"
    cv_folds: int = 5
    walk_forward: bool = False
    lags: tuple[int, ...] = field(default=())

    @property
    def season_length(self) -> int:
        return self.season or DEFAULT_SEASON[self.granularity]

    def problems(self) -> list[str]:
        """Reasons why a run with these settings must not start."""
        found = []
        if self.granularity not in GRANULARITIES:
            found.append(f"unknown granularity {self.granularity!r}")
        elif (self.forecast_start - self.train_start).days < MIN_TRAIN_DAYS[self.granularity]:
            found.append("training window is too short")
        if self.horizon < 1:
            found.append("horizon must be at least one period")
        if self.season is not None and self.season < 1:
            found.append("season must be at least one period")
        if self.unit not in UNIT_LABELS:
            found.append(f"unknown unit {self.unit!r}")
        if len(self.drivers) < 2:
            found.append("at least two drivers are needed")
        unknown = [m for m in self.methods if m not in METHODS]
        if unknown:
            found.append("unknown methods: " + ", ".join(unknown))
        return found

"""A complete run: checked inputs, chosen methods, scenarios, metrics and the report tables."""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from fleetcast.config import SARIMAX, ForecastConfig
from fleetcast.functions.dates import add_periods, report_date
from fleetcast.functions.scalars import unit_rounded
from fleetcast.operators import arima, calendars, explore, metrics, regress, validate
from fleetcast.plans import assemble
from fleetcast.plans.registry import run_method
from fleetcast.plans.status import FORECAST, SKIPPED, usability
from fleetcast.session import materialize
from fleetcast.sources.sinks import write_bundle


class ForecastRun:
    """Forecasts every usable series of ``product (series_id, ds, y)``.

    ``drivers`` is wide (``ds`` and one column per driver). ``scenarios`` holds user
    forecasts ``(series_id, ds, scenario, yhat)``, ``edits`` changed future driver values
    ``(ds, driver, x)``.
    """

    def __init__(self, product: DataFrame, drivers: DataFrame, config: ForecastConfig,
                 scenarios: DataFrame | None = None, edits: DataFrame | None = None):
        problems = config.problems()
        missing = [d for d in config.drivers if d not in drivers.columns]
        if missing:
            problems.append("drivers without a column: " + ", ".join(missing))
        if not re.fullmatch(r"[\w\d _-]+", config.run_name):
            problems.append("run name has characters other than letters, digits, blank, _ and -")
        if problems:
            raise ValueError("; ".join(problems))
        self.config = config
        self._raw_product, self._raw_drivers = product, drivers
        self._scenarios, self._edits = scenarios, edits

    # -- inputs ---------------------------------------------------------------------

    @cached_property
    def _all_products(self) -> DataFrame:
        """The product table, written once: facts behind it are aggregated a single time."""
        product = validate.snap_to_month(self._raw_product) if self.config.granularity == "month" else self._raw_product
        return materialize(product.select("series_id", "ds", F.col("y").cast("double").alias("y")), "product")

    @cached_property
    def drivers(self) -> DataFrame:
        """Chosen drivers with edits applied. Missing values in the training window or the horizon stop the run."""
        names = self.config.drivers
        wide = materialize(self._raw_drivers.select("ds", *[F.col(n).cast("double").alias(n) for n in names]), "drivers")
        if self._edits is not None:
            long = assemble.with_overrides(wide.unpivot(["ds"], list(names), "driver", "x"), self._edits)
            wide = materialize(long.groupBy("ds").pivot("driver", list(names)).agg(F.first("x")), "drivers")
        c = self.config
        long = wide.unpivot(["ds"], list(names), "driver", "x")
        known = calendars.aligned_calendar(long, c.granularity, c, "driver", "x")
        bad = validate.blocked_drivers(known).first()
        if bad["blocked"]:
            raise ValueError(f"driver values are missing in the training window: {bad['drivers']}")
        horizon = calendars.horizon_dates(wide.select(F.lit("drivers").alias("series_id")), self.config)
        gaps = validate.missing_future_drivers(horizon, wide.unpivot(["ds"], list(names), "driver", "x"), names)
        if not gaps.isEmpty():
            raise ValueError("driver values are missing within the horizon")
        return wide

    @cached_property
    def blocked(self) -> DataFrame:
        """Series that cannot be forecast: repeated dates, gaps in the training window, too short a history."""
        c = self.config
        copies = validate.repeated_dates(self._all_products)
        gaps = validate.blocked_series(calendars.aligned_calendar(self._all_products, c.granularity, c, "series_id", "y"))
        short = validate.history_check(self._all_products, c.granularity).where(~F.col("enough"))
        return materialize(
            gaps.select("series_id", F.lit("missing values in the training window").alias("reason")).unionByName(
                short.select("series_id", F.lit("history too short").alias("reason"))).unionByName(
                copies.select("series_id", F.lit("repeated dates").alias("reason"))), "blocked")

    @cached_property
    def product(self) -> DataFrame:
        return materialize(self._all_products.join(self.blocked, "series_id", "left_anti"), "usable-product")

    @cached_property
    def scenarios(self) -> DataFrame | None:
        """Accepted scenarios only."""
        if self._scenarios is None:
            return None
        accepted = validate.scenario_check(self._scenarios, self.config).where("accepted").select("series_id", "scenario")
        return self._scenarios.join(accepted, ["series_id", "scenario"], "left_semi").select("series_id", "ds", "scenario", "yhat")

    # -- exploration ----------------------------------------------------------------

    def decomposition(self) -> DataFrame:
        """Trend, season, rest and outlier score of the training window."""
        train = calendars.training(self.product, self.config)
        return explore.outliers(explore.decompose(train, self.config.season_length))

    def correlations(self) -> DataFrame:
        c = self.config
        upper = add_periods(F.lit(c.forecast_start), F.lit(c.horizon - 1), c.granularity)
        window = self.drivers.where((F.col("ds") >= F.lit(c.train_start)) & (F.col("ds") <= upper))
        return explore.correlations(window, c.drivers)

    # -- results --------------------------------------------------------------------

    @cached_property
    def _method_results(self) -> tuple[DataFrame, DataFrame]:
        parts = [run_method(m, self.product, self.drivers, self.config) for m in self.config.methods]
        forecast = materialize(reduce(DataFrame.unionByName, [p[0] for p in parts]), "forecast")
        params = materialize(reduce(DataFrame.unionByName, [p[1] for p in parts]), "parameters")
        return forecast, params

    @property
    def forecast(self) -> DataFrame:
        """``(series_id, ds, method, kind, yhat)`` rounded by unit."""
        rounded = unit_rounded(F.col("yhat"), F.lit(self.config.unit))
        return self._method_results[0].withColumn("yhat", rounded)

    def status(self) -> DataFrame:
        """``(series_id, method, status, reason)``: one row per series and method."""
        done = self._method_results[0].select("series_id", "method").distinct().withColumn("there", F.lit(True))
        methods = F.explode(F.array(*[F.lit(m) for m in self.config.methods])).alias("method")
        every = usability(self.product, self.config).select("series_id", "reason", methods).join(done, ["series_id", "method"], "left")
        return every.select("series_id", "method", F.when(F.col("there"), FORECAST).otherwise(SKIPPED).alias("status"),
                            F.when(F.col("there").isNull(), F.coalesce("reason", F.lit("no model fits"))).alias("reason"))

    @property
    def parameters(self) -> DataFrame:
        return self._method_results[1]

    def compared(self) -> DataFrame:
        """Methods and scenarios next to the actuals of the horizon."""
        pred = self.forecast.where("kind = 'pred'").select("series_id", "ds", "method", "yhat")
        if self.scenarios is not None:
            pred = assemble.methods_and_scenarios(pred, self.scenarios)
        return pred.join(self.product, ["series_id", "ds"], "left")

    def metric_report(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        return metrics.report(self.compared())

    def fit_report(self) -> DataFrame:
        fit = self.forecast.where("kind = 'fit'").join(self.product, ["series_id", "ds"])
        return metrics.score(fit, metrics.FIT_METRICS)

    def contributions(self, method: str) -> DataFrame:
        """Driver contributions of a linear method, or of the one with exogenous variables; other methods are refused."""
        if method == SARIMAX:
            return arima.driver_contributions(self.product, self.drivers, self.config)
        models = regress.fit_linear(self.product, self.drivers, self.config, method)
        rows, names = regress.scoring_rows(self.product, self.drivers, self.config)
        return regress.contributions(models, rows, names)

    def tables(self) -> dict[str, DataFrame]:
        """All report tables by name. The names."""
        c = self.config
        test_drivers = self.drivers.join(
            calendars.horizon_dates(self.drivers.select(F.lit("d").alias("series_id")), c).select("ds"), "ds", "left_semi")
        pred = self.forecast.where("kind = 'pred'")
        out = {
            "summary": assemble.run_summary(self.product, c),
            "TestTreiber": test_drivers.select(report_date(F.col("ds")).alias("Date"), *c.drivers),
            "Prognose": assemble.forecast_table([pred], c.methods),
            "Parameter": self.parameters,
            "Fit": self.fit_report(),
        }
        for family, (aggregate, per_period) in self.metric_report().items():
            out[f"Metrik_{family}"], out[f"Metrik_{family}_separat"] = aggregate, per_period
        return out

    def write_report(self, folder: str, formats: tuple[str, ...] = ("csv",)) -> dict[str, str]:
        return write_bundle(self.tables(), folder, self.config.run_name, formats)

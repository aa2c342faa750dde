"""The methods a run can use: name to function of (product, drivers, config)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from fleetcast.config import BOOSTING, ELASTIC_NET, HOLT_WINTERS, LASSO, MLR, RANDOM_FOREST, RIDGE, SARIMA, SARIMAX, ForecastConfig
from fleetcast.operators import arima, regress, smooth, trees
from fleetcast.session import materialize

FORECAST_COLUMNS = ("series_id", "ds", "method", "kind", "yhat")
PARAMETER_COLUMNS = ("series_id", "method", "name", "value", "text", "std_err", "p_value")


def _parameters(df: DataFrame) -> DataFrame:
    """The common parameter layout, with NULL for what a method does not report."""
    types = {"value": "double", "text": "string", "std_err": "double", "p_value": "double", "series_id": "string"}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in PARAMETER_COLUMNS])


def _linear(method: str, product: DataFrame, drivers: DataFrame, config: ForecastConfig):
    models = materialize(regress.fit_linear(product, drivers, config, method), "linear-models")
    rows, names = regress.scoring_rows(product, drivers, config)
    return regress.score(models, rows, names), regress.parameters(models, names)


def _trees(method: str, space: trees.Space, product: DataFrame, drivers: DataFrame, config: ForecastConfig, budget=trees.Budget()):
    tuned = trees.tune(product, drivers, config, space, budget)
    spark = product.sparkSession
    params = _parameters(trees.importances(tuned, spark, method)).unionByName(_parameters(trees.parameters(tuned, spark, method)))
    return trees.forecast(tuned, product, drivers, config, method), params


METHOD_FUNCTIONS: dict[str, Callable] = {
    HOLT_WINTERS: lambda product, drivers, config: smooth.holt_winters(product, config),
    **{m: partial(_linear, m) for m in (MLR, RIDGE, LASSO, ELASTIC_NET)},
    SARIMA: lambda product, drivers, config: arima.arima(product, None, config),
    SARIMAX: lambda product, drivers, config: arima.arima(product, drivers, config),
    RANDOM_FOREST: partial(_trees, RANDOM_FOREST, trees.FOREST_SPACE),
    BOOSTING: partial(_trees, BOOSTING, trees.BOOSTING_SPACE),
}


def run_method(method: str, product: DataFrame, drivers: DataFrame, config: ForecastConfig) -> tuple[DataFrame, DataFrame]:
    """``(forecast and fit, parameters)`` of one method for all series."""
    forecast, params = METHOD_FUNCTIONS[method](product, drivers, config)
    return forecast.select(*FORECAST_COLUMNS), _parameters(params)

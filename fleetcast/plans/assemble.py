"""Putting forecasts, actuals, drivers and scenarios together, always by key and date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetcast.config import ForecastConfig
from fleetcast.functions.dates import report_date
from fleetcast.operators.calendars import horizon_rows, training

SERIES_DATE = ["series_id", "ds"]


def chosen_methods(forecast: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    return forecast.where(F.col("method").isin(*methods))


def outer_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every date of either table; values of the other are NULL."""
    return left.join(right, "ds", "full_outer")


def merged_with_scenarios(forecast: DataFrame, scenario: DataFrame) -> DataFrame:
    named = scenario.select(*SERIES_DATE, "scenario", F.col("yhat").alias("scenario_yhat"))
    return forecast.select(*SERIES_DATE, "method", "yhat").join(named, SERIES_DATE)


def methods_wide(forecast: DataFrame, methods: tuple[str, ...], value: str = "yhat") -> DataFrame:
    return forecast.groupBy(*SERIES_DATE).pivot("method", list(methods)).agg(F.first(value))


def with_overrides(drivers: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited future driver values replace the loaded ones."""
    edited = edits.select("ds", "driver", F.col("x").alias("edited"))
    return drivers.join(edited, ["ds", "driver"], "left").select(
        "ds", "driver", F.coalesce("edited", "x").alias("x"))


def train_and_test(product: DataFrame, config: ForecastConfig) -> DataFrame:
    train = training(product, config).select(*SERIES_DATE, "y", F.lit("train").alias("part"))
    test = horizon_rows(product, config).select(*SERIES_DATE, "y", F.lit("test").alias("part"))
    return train.unionByName(test)


def methods_and_scenarios(forecast: DataFrame, scenario: DataFrame) -> DataFrame:
    """Scenarios are scored like methods."""
    return forecast.unionByName(scenario.withColumnRenamed("scenario", "method"))


def forecast_table(parts: list[DataFrame], methods: tuple[str, ...]) -> DataFrame:
    """Long forecasts of several methods as one wide report table."""
    union = reduce(DataFrame.unionByName, parts)
    wide = methods_wide(union, methods)
    return wide.select("series_id", report_date(F.col("ds")).alias("Date"), *[F.col(f"`{m}`") for m in methods])


def actual_and_forecast(product: DataFrame, wide: DataFrame, config: ForecastConfig) -> DataFrame:
    return train_and_test(product, config).drop("part").join(wide, SERIES_DATE, "left")


def coefficients_wide(params: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """One row per series and coefficient name with a column per regression; no row is lost."""
    return params.groupBy("series_id", "name").pivot("method", list(methods)).agg(F.first("value"))


def run_summary(product: DataFrame, config: ForecastConfig) -> DataFrame:
    def day(value):
        return value.strftime("%d.%m.%Y")
    inside = (F.col("ds") >= F.lit(config.train_start)) & (F.col("ds") < F.lit(config.forecast_start))
    return product.groupBy("series_id").agg(F.count_if(inside).alias("train_rows")).select(
        "series_id",
        F.lit(config.unit).alias("unit"),
        F.lit(f"{day(config.train_start)} - {day(config.forecast_start)}").alias("training_span"),
        F.lit(f"{config.horizon} {config.granularity}").alias("horizon"),
        F.lit(f"{config.season_length} {config.granularity}").alias("season"),
        F.array_join(F.array(*[F.lit(x) for x in config.drivers]), ", ").alias("drivers"),
        F.array_join(F.array(*[F.lit(x) for x in config.methods]), ", ").alias("methods"),
        "train_rows")

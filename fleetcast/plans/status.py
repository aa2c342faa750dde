"""Which series a method can forecast, and why not: no series leaves a result without a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetcast.config import ForecastConfig
from fleetcast.functions.dates import add_periods
from fleetcast.operators.calendars import training

FORECAST, SKIPPED = "forecast", "skipped"


def usability(product: DataFrame, config: ForecastConfig) -> DataFrame:
    """``(series_id, rows, reason)`` of every series of ``product``; ``reason`` is NULL where the training window is complete."""
    cut, gran = F.lit(config.forecast_start), config.granularity
    seen = training(product, config).groupBy("series_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("y").isNull()).alias("missing"), F.min("ds").alias("first"), F.max("ds").alias("last"), F.countDistinct("ds").alias("dates"))
    periods = F.months_between(cut, F.col("first")) if gran == "month" else F.datediff(cut, F.col("first")) / (7 if gran == "week" else 1)
    reason = (
        F.when(F.col("rows").isNull(), "no training rows").when(F.col("rows") > F.col("dates"), "repeated dates").when(F.col("missing") > 0, "missing values")
        .when(add_periods(F.col("last"), F.lit(1), gran) != cut, "ends before the forecast").when(F.col("rows") != periods, "gaps in the training window"))
    every = product.select("series_id").distinct().join(seen, "series_id", "left")
    return every.select("series_id", F.coalesce("rows", F.lit(0)).alias("rows"), reason.alias("reason"))


def with_status(product: DataFrame, config: ForecastConfig, forecast: DataFrame, method: str) -> DataFrame:
    """``forecast`` with ``status`` and ``reason``; a series without a forecast has one row, whose dates and values are NULL."""
    names = ["ds", "kind", "yhat"]
    joined = usability(product, config).join(forecast.select("series_id", *names), "series_id", "left")
    there = F.col("ds").isNotNull()
    return joined.select("series_id", F.lit(method).alias("method"), *names, F.when(there, FORECAST).otherwise(SKIPPED).alias("status"),
                         F.when(~there, F.coalesce("reason", F.lit("no model fits"))).alias("reason"))

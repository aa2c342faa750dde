"""Complete calendars, future dates, and the training and horizon windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.config import ForecastConfig
from fleetcast.functions.dates import add_periods, period_sequence


def complete_calendar(product: DataFrame, gran: str, key: str = "series_id", value: str = "y") -> DataFrame:
    """Every period between first and last date of a key; gaps become NULL values, repeated dates stay repeated.

    One pass: the span is a window over the same key as the fill, and the gap in front of
    each row is generated by the row itself, so no calendar is joined back.
    """
    nxt = F.lead("ds").over(Window.partitionBy(key).orderBy("ds"))
    last_missing = add_periods(F.col("next_ds"), F.lit(-1), gran)
    dates = F.when(F.col("next_ds").isNull() | (F.col("next_ds") <= F.col("ds")), F.array("ds")).otherwise(
        period_sequence(F.col("ds"), last_missing, gran))
    return (
        product.select(key, "ds", value).withColumn("next_ds", nxt)
        .select(key, F.col("ds").alias("known_ds"), value, F.explode(dates).alias("ds"))
        .select(key, "ds", F.when(F.col("ds") == F.col("known_ds"), F.col(value)).alias(value))
    )


def aligned_calendar(table: DataFrame, gran: str, config: ForecastConfig, key: str, value: str) -> DataFrame:
    """The training window of every key with NULL where a period has no row at all."""
    last = add_periods(F.lit(config.forecast_start), F.lit(-1), gran)
    grid = table.select(key).distinct().select(
        key, F.explode(period_sequence(F.lit(config.train_start), last, gran)).alias("ds"))
    return grid.join(training(table.select(key, "ds", value), config), [key, "ds"], "left")


def training(df: DataFrame, config: ForecastConfig) -> DataFrame:
    return df.where((F.col("ds") >= F.lit(config.train_start)) & (F.col("ds") < F.lit(config.forecast_start)))


def horizon_rows(df: DataFrame, config: ForecastConfig, key: str = "series_id") -> DataFrame:
    """First ``horizon`` rows of each key at or after the forecast start."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy("ds"))
    return (
        df.where(F.col("ds") >= F.lit(config.forecast_start))
        .withColumn("step", rn.cast("long")).where(F.col("step") <= config.horizon)
    )


def horizon_dates(keys: DataFrame, config: ForecastConfig, key: str = "series_id") -> DataFrame:
    """``(key, ds, step)``: the forecast dates, generated without touching the data."""
    last = add_periods(F.lit(config.forecast_start), F.lit(config.horizon - 1), config.granularity)
    dates = period_sequence(F.lit(config.forecast_start), last, config.granularity)
    return keys.select(key).distinct().select(key, F.posexplode(dates).alias("pos", "ds")).select(
        key, "ds", (F.col("pos") + 1).cast("long").alias("step"))


def extended_horizon(df: DataFrame, config: ForecastConfig, key: str = "series_id") -> DataFrame:
    """Known dates of the horizon, continued past the last known date up to ``horizon`` rows."""
    known = horizon_rows(df, config, key)
    spans = df.groupBy(key).agg(F.max("ds").alias("last_ds"))
    have = known.groupBy(key).agg(F.count("*").alias("have"), F.max("ds").alias("last_known"))
    tail = (
        spans.join(have, key, "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .withColumn("from_ds", F.coalesce("last_known", "last_ds"))
        .where(F.col("have") < config.horizon)
    )
    dates = period_sequence(
        add_periods(F.col("from_ds"), F.lit(1), config.granularity),
        add_periods(F.col("from_ds"), F.lit(config.horizon) - F.col("have"), config.granularity),
        config.granularity)
    generated = tail.select(key, "have", F.posexplode(dates).alias("pos", "ds")).select(
        key, "ds", (F.col("have") + F.col("pos") + 1).cast("long").alias("step"), F.lit(False).alias("known"))
    return known.select(key, "ds", "step", F.lit(True).alias("known")).unionByName(generated)


def next_periods(df: DataFrame, gran: str, horizon: int, key: str = "series_id") -> DataFrame:
    """The ``horizon`` periods after the last date of each key."""
    last = df.groupBy(key).agg(F.max("ds").alias("last_ds"))
    dates = period_sequence(
        add_periods(F.col("last_ds"), F.lit(1), gran), add_periods(F.col("last_ds"), F.lit(horizon), gran), gran)
    return last.select(key, F.explode(dates).alias("ds"))


def chosen_drivers(drivers_long: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return drivers_long.where(F.col("driver").isin(*names))


def position(key: str = "series_id") -> Column:
    """Zero-based position of a row within its series."""
    return F.row_number().over(Window.partitionBy(key).orderBy("ds")) - 1

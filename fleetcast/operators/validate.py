"""Checks and cleansing of product and driver tables, for all series at once.

Every check is one grouped aggregation or one window over ``(series_id, ds)``. Rows are
first reduced to one per series and period, so a window never holds more rows than the
calendar has periods.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.config import (
    DEFAULT_SEASON, FIRST_FORECAST_ROW, LAST_TRAIN_ROW, MIN_SPAN_DAYS, MIN_TRAIN_DAYS, ForecastConfig,
)
from fleetcast.functions.dates import add_periods, parse_day_first, period_sequence
from fleetcast.functions.scalars import zero_normalized

# Texts that stand for a missing number in delimited files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
RUN_NAME_PATTERN = r"^[\p{L}\p{N} _-]+$"


def by_granularity(gran: Column, values: dict) -> Column:
    branches = F
    for name, value in values.items():
        branches = branches.when(gran == name, F.lit(value))
    return branches


def ordered(key: str = "series_id") -> Window:
    return Window.partitionBy(key).orderBy("ds")


# -- raw tables -------------------------------------------------------------------------

def drop_undated(df: DataFrame, date_column: str) -> DataFrame:
    """Rows without a date carry no observation."""
    return df.where(F.col(date_column).isNotNull() & (F.trim(date_column) != ""))


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Columns without a header, which readers name ``Unnamed: n`` or ``_cn``."""
    return df.drop(*[c for c in df.columns if "Unnamed" in c or re.fullmatch(r"_c\d+", c)])


def number_text(text: Column) -> Column:
    """Cell text with the usual markers for a missing number turned into NULL."""
    stripped = F.trim(text)
    return F.when(~stripped.isin(*MISSING_TEXTS), stripped)


def to_number(text: Column) -> Column:
    return zero_normalized(number_text(text).try_cast("double"))


def text_cells(df: DataFrame, key: str, value: str) -> DataFrame:
    """Columns (long form: keys) that hold text where a number is expected."""
    is_text = number_text(F.col(value)).isNotNull() & number_text(F.col(value)).try_cast("double").isNull()
    return df.groupBy(key).agg(F.count_if(is_text).alias("text_cells")).where("text_cells > 0")


def missing_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(F.col(value).isNull()).alias("missing"))


def typed_long(df: DataFrame, key: str = "series_id") -> DataFrame:
    """``(key, date_text, y_text)`` to typed ``(key, ds, y)``; rejected keys are left out."""
    rejected = text_cells(df, key, "y_text").select(key)
    dated = drop_undated(df, "date_text").join(rejected, key, "left_anti")
    return dated.select(key, parse_day_first(F.col("date_text")).alias("ds"), to_number(F.col("y_text")).alias("y"))


# -- calendar ---------------------------------------------------------------------------

def infer_granularity(product: DataFrame) -> DataFrame:
    """Granularity from the first two dates of each series; NULL rejects the series."""
    dates = F.collect_set("ds")
    # A series with repeated dates is irregular whatever its first gap is.
    repeated = F.count("ds") > F.size(dates)
    gap = F.when(F.size("d") > 1, F.datediff(F.get("d", F.lit(1)), F.get("d", F.lit(0))))
    out = product.groupBy("series_id").agg(
        F.slice(F.array_sort(dates), 1, 2).alias("d"), repeated.alias("repeated"))
    return out.select(
        "series_id", F.get("d", F.lit(0)).alias("first_ds"), F.get("d", F.lit(1)).alias("second_ds"),
        gap.cast("long").alias("gap_days"),
        F.when(F.col("repeated"), F.lit(None)).when(gap.between(28, 31), "month")
        .when(gap == 1, "day").alias("gran"),
    )


def gaps(product: DataFrame) -> DataFrame:
    """Distance of each row to the previous one of its series."""
    before = F.lag("ds").over(ordered())
    return product.withColumn("prev_ds", before).withColumn(
        "gap_days", F.datediff("ds", "prev_ds").cast("long"))


def spacing_violations(product: DataFrame) -> DataFrame:
    """First pair of dates whose distance does not fit the series' first gap.

    Repeated dates count as a distance of zero. They are folded before the window, so a
    series with any number of copies stays calendar-sized.
    """
    w = ordered()
    dates = product.groupBy("series_id", "ds").agg(F.count("*").alias("copies"))
    marked = gaps(dates).withColumn("rn", F.row_number().over(w)).withColumn(
        "first_gap", F.max(F.when(F.col("rn") == 2, F.col("gap_days"))).over(Window.partitionBy("series_id")))
    fits = (
        F.when(F.col("first_gap").between(28, 31), F.col("gap_days").between(28, 31))
        .when(F.col("first_gap") == 1, F.col("gap_days") == 1)
        .otherwise(False)
    )
    repeated = F.col("copies") > 1
    pair = F.when(repeated, F.struct(F.col("ds").alias("prev_ds"), "ds", F.lit(0).cast("long").alias("gap_days"))).otherwise(
        F.struct("prev_ds", "ds", "gap_days"))
    return (
        marked.where(repeated | ((F.col("rn") >= 2) & ~fits))
        .groupBy("series_id")
        .agg(F.count("*").alias("violations"), F.min_by(pair, "ds").alias("v"))
        .select("series_id", "violations", F.col("v.prev_ds").alias("from_ds"),
                F.col("v.ds").alias("to_ds"), F.col("v.gap_days").alias("gap_days"))
    )


def repeated_dates(product: DataFrame) -> DataFrame:
    """Series with more than one row for a date."""
    copies = product.groupBy("series_id", "ds").agg(F.count("*").alias("copies")).where("copies > 1")
    return copies.groupBy("series_id").agg(F.count("*").alias("repeated"))


def snap_to_month(product: DataFrame) -> DataFrame:
    return product.withColumn("ds", F.trunc("ds", "MM"))


def history_check(product: DataFrame, gran: str) -> DataFrame:
    span = F.datediff(F.max("ds"), F.min("ds")).cast("long")
    return product.groupBy("series_id").agg(
        span.alias("span_days"), (span >= MIN_SPAN_DAYS[gran]).alias("enough"))


def profile(product: DataFrame, key: str = "series_id", value: str = "y") -> DataFrame:
    return product.groupBy(key).agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"))


def training_start_bounds(product: DataFrame, gran: str) -> DataFrame:
    """Earliest and latest training start: first row, and 7th or 12th row from the end."""
    tail = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ds")))
    return (
        product.withColumn("back", tail).groupBy("series_id")
        .agg(F.min("ds").alias("min_start"),
             F.max(F.when(F.col("back") == LAST_TRAIN_ROW[gran], F.col("ds"))).alias("max_start"))
    )


def forecast_start_bounds(product: DataFrame, gran: str) -> DataFrame:
    """Earliest forecast start is row 8 or 13; the latest is one period past the end."""
    return (
        product.withColumn("rn", F.row_number().over(ordered())).groupBy("series_id")
        .agg(F.max(F.when(F.col("rn") == FIRST_FORECAST_ROW[gran], F.col("ds"))).alias("min_start"),
             add_periods(F.max("ds"), F.lit(1), gran).alias("max_start"))
    )


# -- settings ---------------------------------------------------------------------------

def config_gate(product: DataFrame, config: ForecastConfig) -> DataFrame:
    """Per series: do the settings leave a long enough training window inside its dates?"""
    problems = config.problems()
    span = (config.forecast_start - config.train_start).days
    usable = F.count_if((F.col("ds") >= F.lit(config.train_start)) & (F.col("ds") < F.lit(config.forecast_start)))
    return product.groupBy("series_id").agg(
        usable.alias("train_rows"),
        F.lit(span).cast("long").alias("train_span_days"),
        (F.lit(not problems) & F.lit(span >= MIN_TRAIN_DAYS[config.granularity])).alias("may_start"))


def default_season(granularity: DataFrame, chosen: int | None = None) -> DataFrame:
    default = by_granularity(F.col("gran"), DEFAULT_SEASON)
    return granularity.select(
        "series_id", "gran", F.coalesce(F.lit(chosen).cast("long"), default.cast("long")).alias("season"))


def valid_run_name(name: Column) -> Column:
    return name.rlike(RUN_NAME_PATTERN)


def missing_choices(available: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Chosen names that no table holds."""
    return wanted.join(available.select(key).distinct(), key, "left_anti")


# -- completeness -----------------------------------------------------------------------

def blocked_series(complete: DataFrame, key: str = "series_id", value: str = "y") -> DataFrame:
    """Keys with missing values; the input must be on the complete calendar."""
    return missing_counts(complete, key, value).where("missing > 0")


def blocked_drivers(complete_drivers: DataFrame) -> DataFrame:
    """One row naming every driver that misses values in the window."""
    names = F.array_sort(F.collect_set("driver"))
    return blocked_series(complete_drivers, "driver", "x").agg(
        F.count("*").alias("blocked"), F.array_join(names, ", ").alias("drivers"))


def enough_drivers(drivers: DataFrame, minimum: int = 2) -> DataFrame:
    per_name = drivers.groupBy("driver").agg(F.count("x").alias("values"))
    return per_name.where("values > 0").agg(
        F.count("*").alias("drivers"), (F.count("*") >= minimum).alias("may_start"))


def missing_future_drivers(horizon: DataFrame, drivers: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Horizon dates without a value for a chosen driver."""
    wanted = horizon.select("ds").distinct().select(
        "ds", F.explode(F.array(*[F.lit(n) for n in names])).alias("driver"))
    known = drivers.where(F.col("x").isNotNull()).select("ds", "driver")
    return wanted.join(known, ["ds", "driver"], "left_anti")


def scenario_check(scenario: DataFrame, config: ForecastConfig) -> DataFrame:
    """A scenario counts only with a name and one non-zero value for each date of the horizon.

    The horizon's dates follow from the configuration, so each row finds out by itself whether its date is one of them.
    """
    last = add_periods(F.lit(config.forecast_start), F.lit(config.horizon - 1), config.granularity)
    dates = period_sequence(F.lit(config.forecast_start), last, config.granularity)
    bad = F.count_if(F.col("yhat").isNull() | (F.col("yhat") == 0))
    known = F.when(F.array_contains(dates, F.col("ds").cast("date")), F.col("ds"))
    named = F.col("scenario").isNotNull() & (F.trim("scenario") != "")
    whole = (F.col("rows") == config.horizon) & (F.col("horizon_dates") == config.horizon)
    return (
        scenario.groupBy("series_id", "scenario")
        .agg(F.count("*").alias("rows"), bad.alias("bad_rows"), F.countDistinct(known).alias("horizon_dates"))
        .withColumn("accepted", named & (F.col("bad_rows") == 0) & whole)
    )

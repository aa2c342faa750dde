"""Sources, checks and cleansing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetcast.catalog.base import MONTHLY, MONTHLY_LATE, query, sql
from fleetcast.functions import dates
from fleetcast.operators import calendars, validate
from fleetcast.session import scratch_folder
from fleetcast.sources import star, text

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def product_any(spark: SparkSession, d: str) -> DataFrame:
    return (
        star.product_monthly(spark, d).unionByName(star.product_total_monthly(spark, d))
        .unionByName(star.product_daily(spark, d))
    )


def irregular(spark: SparkSession, d: str) -> DataFrame:
    """Series with one missing period each; the rest stay regular."""
    monthly = star.product_monthly(spark, d).where(
        (F.col("ds") != "1998-05-01") | (F.col("series_id") > "Brand#2"))
    daily = star.product_daily(spark, d).where((F.col("ds") != "2024-01-15") | (F.col("series_id") != "click"))
    return monthly.unionByName(daily)


def raw_long(spark: SparkSession, d: str) -> DataFrame:
    """Every product row as an uploader would see it: texts, mixed date formats, faults."""
    ds = F.col("ds")
    date_text = (
        F.when(ds == "1997-02-01", F.lit(None))
        .when(F.month(ds) % 2 == 0, F.date_format(ds, "dd.MM.yyyy"))
        .otherwise(F.date_format(ds, "dd-MM-yyyy"))
    )
    y_text = (
        F.when((F.col("series_id") == "Brand#3") & (ds == "1999-03-01"), "broken")
        .when((F.col("series_id") == "Brand#7") & (ds == "1999-04-01"), "NaN")
        .when((F.col("series_id") == "Brand#9") & (ds == "1999-05-01"), "-0.0")
        .otherwise(F.col("y").cast("decimal(18,2)").cast("string"))
    )
    return star.product_monthly(spark, d).select("series_id", date_text.alias("date_text"), y_text.alias("y_text"), "ds")


def raw_wide(spark: SparkSession, d: str) -> DataFrame:
    return (
        raw_long(spark, d).groupBy("ds").pivot("series_id", BRANDS).agg(F.first("y_text"))
        .join(raw_long(spark, d).groupBy("ds").agg(F.max("date_text").alias("Date")), "ds")
        .withColumn("Unnamed: 3", F.lit(None).cast("string"))
        .select("Date", *BRANDS, "Unnamed: 3")
    )


RAW = """
raw_long AS (
  SELECT series_id, ds,
    CASE WHEN ds = DATE '1997-02-01' THEN NULL
         WHEN month(ds) % 2 = 0 THEN strftime(ds, '%d.%m.%Y') ELSE strftime(ds, '%d-%m-%Y') END AS date_text,
    CASE WHEN series_id = 'Brand#3' AND ds = DATE '1999-03-01' THEN 'broken'
         WHEN series_id = 'Brand#7' AND ds = DATE '1999-04-01' THEN 'NaN'
         WHEN series_id = 'Brand#9' AND ds = DATE '1999-05-01' THEN '-0.0'
         ELSE CAST(CAST(y AS DECIMAL(18,2)) AS VARCHAR) END AS y_text
  FROM product_monthly)"""
TYPED = """
typed AS (
  SELECT series_id, ds,
    CASE WHEN series_id = 'Brand#7' AND ds = DATE '1999-04-01' THEN NULL
         WHEN series_id = 'Brand#9' AND ds = DATE '1999-05-01' THEN 0.0 ELSE y END AS y
  FROM product_monthly WHERE ds <> DATE '1997-02-01' AND series_id <> 'Brand#3')"""

# A wide file has a cell for every date and column: absent values become NULL.
WIDE = sql("""
SELECT b.series_id, c.ds, t.y FROM (SELECT DISTINCT series_id FROM product_monthly WHERE series_id <> 'Brand#3') b
CROSS JOIN (SELECT DISTINCT ds FROM product_monthly WHERE ds <> DATE '1997-02-01') c
LEFT JOIN typed t ON t.series_id = b.series_id AND t.ds = c.ds""", TYPED)


# -- sources ----------------------------------------------------------------------------

@query("s1_csv_source", WIDE)
def s1_csv_source(spark, d):
    path = scratch_folder(spark, "wide-csv")
    raw_wide(spark, d).write.option("header", True).csv(path)
    return validate.typed_long(text.wide_to_long(text.read_table(spark, path)))


@query("s2_whitespace_source", WIDE)
def s2_whitespace_source(spark, d):
    path = scratch_folder(spark, "wide-txt")
    wide = raw_wide(spark, d).where("Date IS NOT NULL").select("Date", *BRANDS)
    wide.write.option("header", True).option("sep", "\t").option("nullValue", "NaN").csv(path)
    return validate.typed_long(text.wide_to_long(text.read_table(spark, path)))


@query("s4_example_loader", sql("""
SELECT series_id AS name, strftime(ds, '%d-%m-%Y') AS "Date", y AS value FROM product_monthly
UNION ALL SELECT driver, strftime(ds, '%d-%m-%Y'), x FROM driver_long"""))
def s4_example_loader(spark, d):
    products = star.product_monthly(spark, d).select(
        F.col("series_id").alias("name"), dates.report_date(F.col("ds")).alias("Date"), F.col("y").alias("value"))
    drivers = star.driver_long(spark, d).select(
        F.col("driver").alias("name"), dates.report_date(F.col("ds")).alias("Date"), F.col("x").alias("value"))
    return products.unionByName(drivers)


@query("s5_wide_to_long", sql("SELECT ds, driver, x FROM driver_long"))
def s5_wide_to_long(spark, d):
    return star.driver_monthly(spark, d).unpivot(["ds"], list(star.DRIVERS), "driver", "x")


@query("s5_long_to_wide", sql(
    "SELECT ds, " + ", ".join(f"MAX(CASE WHEN series_id = '{b}' THEN y END) AS \"{b}\"" for b in BRANDS)
    + " FROM product_monthly GROUP BY ds"))
def s5_long_to_wide(spark, d):
    return text.long_to_wide(star.product_monthly(spark, d), BRANDS, "series_id", "y")


# -- checks of raw tables ---------------------------------------------------------------

@query("v01_drop_undated", sql("SELECT series_id, date_text, y_text FROM raw_long WHERE date_text IS NOT NULL", RAW))
def v01(spark, d):
    return validate.drop_undated(raw_long(spark, d), "date_text").select("series_id", "date_text", "y_text")


@query("v02_drop_unnamed", sql("""
SELECT ds, n_orders, n_customers FROM driver_monthly"""))
def v02(spark, d):
    named = star.driver_monthly(spark, d).select(
        "ds", "n_orders", "n_customers", F.col("urgent_orders").alias("Unnamed: 3"), F.col("open_orders").alias("_c4"))
    return validate.drop_unnamed(named)


@query("v03_text_cells", sql("""
SELECT series_id, COUNT(*) AS text_cells FROM raw_long
WHERE y_text <> 'NaN' AND TRY_CAST(y_text AS DOUBLE) IS NULL GROUP BY 1""", RAW))
def v03(spark, d):
    return validate.text_cells(raw_long(spark, d), "series_id", "y_text")


@query("v04_missing_counts", sql("""
SELECT series_id, COUNT(*) FILTER (WHERE y_text = 'NaN') AS missing FROM raw_long GROUP BY 1""", RAW))
def v04(spark, d):
    numbers = raw_long(spark, d).withColumn("y", validate.number_text(F.col("y_text")))
    return validate.missing_counts(numbers, "series_id", "y")


@query("v05_parse_dates", sql("""
SELECT series_id, date_text, COALESCE(TRY_STRPTIME(date_text, '%d-%m-%Y'), TRY_STRPTIME(date_text, '%d.%m.%Y'))::DATE AS ds
FROM raw_long""", RAW))
def v05(spark, d):
    return raw_long(spark, d).select("series_id", "date_text", dates.parse_day_first(F.col("date_text")).alias("ds"))


@query("v06_cast_double", sql("""
SELECT series_id, ds, TRY_CAST(NULLIF(y_text, 'NaN') AS DOUBLE) AS y, TRY_CAST(NULLIF(y_text, 'NaN') AS DOUBLE) IS NULL AS lost
FROM raw_long""", RAW))
def v06(spark, d):
    number = validate.number_text(F.col("y_text")).try_cast("double")
    return raw_long(spark, d).select("series_id", "ds", number.alias("y"), number.isNull().alias("lost"))


@query("v07_zero_normalized", sql("""
SELECT series_id, ds, CASE WHEN y_text = '-0.0' THEN 0.0 ELSE TRY_CAST(NULLIF(y_text, 'NaN') AS DOUBLE) END AS y
FROM raw_long""", RAW))
def v07(spark, d):
    return raw_long(spark, d).select("series_id", "ds", validate.to_number(F.col("y_text")).alias("y"))


# -- calendar checks --------------------------------------------------------------------

@query("v08_granularity", sql("""
SELECT series_id, first_ds, second_ds, date_diff('day', first_ds, second_ds) AS gap_days,
  CASE WHEN date_diff('day', first_ds, second_ds) BETWEEN 28 AND 31 THEN 'month'
       WHEN date_diff('day', first_ds, second_ds) = 1 THEN 'day' END AS gran
FROM (SELECT series_id, MAX(ds) FILTER (WHERE rn = 1) AS first_ds, MAX(ds) FILTER (WHERE rn = 2) AS second_ds
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS rn FROM product_any) GROUP BY 1)"""))
def v08(spark, d):
    return validate.infer_granularity(product_any(spark, d))


GAPS = """
gaps AS (
  SELECT series_id, ds, LAG(ds) OVER w AS prev_ds, date_diff('day', LAG(ds) OVER w, ds) AS gap_days,
         ROW_NUMBER() OVER w AS rn
  FROM irregular WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
bad_gaps AS (
  SELECT g.*, f.gap_days AS first_gap FROM gaps g JOIN gaps f ON g.series_id = f.series_id AND f.rn = 2
  WHERE g.rn >= 2 AND NOT (CASE WHEN f.gap_days BETWEEN 28 AND 31 THEN g.gap_days BETWEEN 28 AND 31
                                WHEN f.gap_days = 1 THEN g.gap_days = 1 ELSE FALSE END))"""


@query("v09_regular_spacing", sql("""
SELECT series_id, COUNT(*) AS violations, arg_min(prev_ds, ds) AS from_ds, MIN(ds) AS to_ds,
       arg_min(gap_days, ds) AS gap_days FROM bad_gaps GROUP BY 1""", GAPS))
def v09(spark, d):
    return validate.spacing_violations(irregular(spark, d))


@query("v10_month_snap", sql("""
SELECT DISTINCT series_id, ds, ds + 14 AS raw_ds FROM product_monthly"""))
def v10(spark, d):
    shifted = star.product_monthly(spark, d).select("series_id", F.date_add("ds", 14).alias("raw_ds"), F.date_add("ds", 14).alias("ds"))
    return validate.snap_to_month(shifted)


@query("v11_history", sql("""
SELECT series_id, date_diff('day', MIN(ds), MAX(ds)) AS span_days,
       date_diff('day', MIN(ds), MAX(ds)) >= 366 AS enough FROM product_any GROUP BY 1"""))
def v11(spark, d):
    return validate.history_check(product_any(spark, d), "month")


@query("v12_profile", sql("""
SELECT series_id, MIN(ds) AS first_ds, MAX(ds) AS last_ds, COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE y IS NULL) AS missing FROM product_any GROUP BY 1"""))
def v12(spark, d):
    return validate.profile(product_any(spark, d))


def _bounds_sql(first: int, last: int, source: str, plus: str) -> tuple[str, str]:
    ranked = f"""
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS rn,
                  ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM {source})"""
    train = sql(f"""SELECT series_id, MIN(ds) AS min_start, MAX(ds) FILTER (WHERE back = {last}) AS max_start
FROM ranked GROUP BY 1""", ranked)
    forecast = sql(f"""SELECT series_id, MAX(ds) FILTER (WHERE rn = {first}) AS min_start,
CAST(MAX(ds) + {plus} AS DATE) AS max_start FROM ranked GROUP BY 1""", ranked)
    return train, forecast


_MONTH_BOUNDS = _bounds_sql(13, 12, "product_monthly", "INTERVAL 1 MONTH")
_DAY_BOUNDS = _bounds_sql(8, 7, "product_daily", "INTERVAL 1 DAY")


@query("v13_training_start_month", _MONTH_BOUNDS[0])
def v13_month(spark, d):
    return validate.training_start_bounds(star.product_monthly(spark, d), "month")


@query("v13_training_start_day", _DAY_BOUNDS[0])
def v13_day(spark, d):
    return validate.training_start_bounds(star.product_daily(spark, d), "day")


@query("v14_forecast_start_month", _MONTH_BOUNDS[1])
def v14_month(spark, d):
    return validate.forecast_start_bounds(star.product_monthly(spark, d), "month")


@query("v14_forecast_start_day", _DAY_BOUNDS[1])
def v14_day(spark, d):
    return validate.forecast_start_bounds(star.product_daily(spark, d), "day")


# -- settings ---------------------------------------------------------------------------

@query("v15_config_gate", sql("""
SELECT series_id, COUNT(*) FILTER (WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01') AS train_rows,
       date_diff('day', DATE '1996-01-01', DATE '2000-07-01') AS train_span_days,
       date_diff('day', DATE '1996-01-01', DATE '2000-07-01') >= 365 AS may_start
FROM product_monthly GROUP BY 1"""))
def v15(spark, d):
    return validate.config_gate(star.product_monthly(spark, d), MONTHLY)


@query("v16_default_season", sql("""
SELECT series_id, CASE WHEN gap BETWEEN 28 AND 31 THEN 'month' WHEN gap = 1 THEN 'day' END AS gran,
       CAST(CASE WHEN gap BETWEEN 28 AND 31 THEN 12 WHEN gap = 1 THEN 7 END AS DOUBLE) AS season
FROM (SELECT series_id, date_diff('day', MAX(ds) FILTER (WHERE rn = 1), MAX(ds) FILTER (WHERE rn = 2)) AS gap
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS rn FROM product_any) GROUP BY 1)"""))
def v16(spark, d):
    return validate.default_season(validate.infer_granularity(product_any(spark, d))).withColumn("season", F.col("season").cast("double"))


# -- completeness -----------------------------------------------------------------------

@query("v17_blocked_series", sql("""
SELECT s.series_id, COUNT(*) FILTER (WHERE p.y IS NULL) AS missing
FROM (SELECT DISTINCT series_id FROM irregular WHERE series_id LIKE 'Brand%') s
CROSS JOIN (SELECT UNNEST(generate_series(DATE '1996-01-01', DATE '2000-06-01', INTERVAL 1 MONTH))::DATE AS ds) c
LEFT JOIN irregular p ON p.series_id = s.series_id AND p.ds = c.ds
GROUP BY 1 HAVING COUNT(*) FILTER (WHERE p.y IS NULL) > 0"""))
def v17(spark, d):
    monthly = irregular(spark, d).where(F.col("series_id").startswith("Brand"))
    return validate.blocked_series(calendars.aligned_calendar(monthly, "month", MONTHLY, "series_id", "y"))


def drivers_with_gap(spark, d):
    """Drivers with planted missing values: one month each in two of them."""
    gap = (
        ((F.col("driver") == "urgent_orders") & (F.col("ds") == "1998-03-01"))
        | ((F.col("driver") == "open_orders") & (F.col("ds") == "1999-07-01"))
    )
    return star.driver_long(spark, d).withColumn("x", F.when(~gap, F.col("x")))


@query("v18_blocked_drivers", sql("""
SELECT COUNT(*) AS blocked, string_agg(driver, ', ' ORDER BY driver) AS drivers
FROM (SELECT driver FROM driver_long WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01'
      AND ((driver = 'urgent_orders' AND ds = DATE '1998-03-01') OR (driver = 'open_orders' AND ds = DATE '1999-07-01'))
      GROUP BY 1)"""))
def v18(spark, d):
    complete = calendars.aligned_calendar(drivers_with_gap(spark, d), "month", MONTHLY, "driver", "x")
    return validate.blocked_drivers(complete)


@query("v19_enough_drivers", sql("""
SELECT COUNT(DISTINCT driver) AS drivers, COUNT(DISTINCT driver) >= 2 AS may_start FROM driver_long"""))
def v19(spark, d):
    return validate.enough_drivers(star.driver_long(spark, d))


@query("v20_missing_future_drivers", sql("""
SELECT c.ds, n.driver
FROM (SELECT UNNEST(generate_series(DATE '2001-03-01', DATE '2002-02-01', INTERVAL 1 MONTH))::DATE AS ds) c
CROSS JOIN (SELECT DISTINCT driver FROM driver_long) n
LEFT JOIN driver_long l ON l.ds = c.ds AND l.driver = n.driver WHERE l.x IS NULL"""))
def v20(spark, d):
    drivers = star.driver_long(spark, d)
    horizon = calendars.horizon_dates(drivers, MONTHLY_LATE, "driver")
    return validate.missing_future_drivers(horizon, drivers, star.DRIVERS)


def scenarios(spark, d):
    """User scenarios over the horizon: five percent more, one filled with zeros, one for the year before, one with a date twice."""
    actual = calendars.horizon_rows(star.product_monthly(spark, d), MONTHLY)

    def values(name, factor, ds=F.col("ds")):
        return F.struct(F.lit(name).alias("scenario"), ds.alias("ds"), (F.col("y") * factor).alias("yhat"))

    twice = F.when(F.col("ds") == "2000-08-01", F.lit("2000-07-01").cast("date")).otherwise(F.col("ds"))
    return actual.select("series_id", F.explode(F.array(
        values("plus five", 1.05), values("empty", 0), values("last year", 1.05, F.add_months("ds", -12)), values("twice", 1.05, twice))).alias("s")
    ).select("series_id", "s.ds", "s.scenario", "s.yhat")


HORIZON = """
horizon AS (
  SELECT series_id, ds, y, step FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS step
    FROM product_monthly WHERE ds >= DATE '2000-07-01') WHERE step <= 12)"""
SCENARIO = """
scenario AS (
  SELECT series_id, ds, 'plus five' AS scenario, y * CAST(1.05 AS DOUBLE) AS yhat FROM horizon
  UNION ALL SELECT series_id, ds, 'empty', y * 0 FROM horizon
  UNION ALL SELECT series_id, CAST(ds - INTERVAL 12 MONTH AS DATE), 'last year', y * CAST(1.05 AS DOUBLE) FROM horizon
  UNION ALL SELECT series_id, CASE WHEN ds = DATE '2000-08-01' THEN DATE '2000-07-01' ELSE ds END, 'twice', y * CAST(1.05 AS DOUBLE) FROM horizon)"""


@query("v21_scenario_check", sql("""
SELECT series_id, scenario, COUNT(*) AS rows, COUNT(*) FILTER (WHERE yhat IS NULL OR yhat = 0) AS bad_rows,
       COUNT(DISTINCT ds) FILTER (WHERE ds >= DATE '2000-07-01' AND ds < DATE '2001-07-01') AS horizon_dates,
       COUNT(*) = 12 AND COUNT(*) FILTER (WHERE yhat IS NULL OR yhat = 0) = 0
         AND COUNT(DISTINCT ds) FILTER (WHERE ds >= DATE '2000-07-01' AND ds < DATE '2001-07-01') = 12 AS accepted
FROM scenario GROUP BY 1, 2""", HORIZON, SCENARIO))
def v21(spark, d):
    return validate.scenario_check(scenarios(spark, d), MONTHLY)


@query("v22_run_name", """
SELECT p_name, p_brand AS run_name, CAST(regexp_full_match(p_brand, '[\\p{L}\\p{N} _-]+') AS BOOLEAN) AS brand_ok,
       CAST(regexp_full_match(p_name, '[\\p{L}\\p{N} _-]+') AS BOOLEAN) AS name_ok, COUNT(*) AS parts
FROM part GROUP BY ALL""")
def v22(spark, d):
    names = star.table(spark, d, "part").groupBy("p_name", F.col("p_brand").alias("run_name")).agg(F.count("*").alias("parts"))
    return names.withColumn("brand_ok", validate.valid_run_name(F.col("run_name"))).withColumn(
        "name_ok", validate.valid_run_name(F.col("p_name")))


@query("v23_missing_choices", sql("""
SELECT p_brand || '!' AS series_id FROM part GROUP BY 1"""))
def v23(spark, d):
    product = star.product_monthly(spark, d)
    brands = star.table(spark, d, "part").select(F.col("p_brand").alias("series_id")).distinct()
    wanted = brands.unionByName(brands.select(F.concat("series_id", F.lit("!")).alias("series_id")))
    return validate.missing_choices(product, wanted, "series_id")

"""Calendars, projections, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fleetcast.catalog.accuracy import NAIVE, naive_forecast
from fleetcast.catalog.base import DAILY, MONTHLY, MONTHLY_LATE, query, sql
from fleetcast.catalog.ingest import HORIZON, SCENARIO, drivers_with_gap, irregular, scenarios
from fleetcast.config import METHODS, UNIT_LABELS
from fleetcast.functions import dates
from fleetcast.functions.scalars import rounded, unit_label, unit_rounded
from fleetcast.operators import calendars, explore, validate
from fleetcast.plans import assemble
from fleetcast.sources import star

TRAIN = """
train AS (SELECT * FROM product_monthly WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01')"""


# -- calendar ---------------------------------------------------------------------------

def _complete_sql(like: str, gran: str) -> str:
    return sql(f"""
SELECT c.series_id, c.ds, p.y FROM (
  SELECT series_id, UNNEST(generate_series(lo, hi, INTERVAL 1 {gran}))::DATE AS ds
  FROM (SELECT series_id, MIN(ds) AS lo, MAX(ds) AS hi FROM irregular WHERE series_id {like} 'Brand%' GROUP BY 1)) c
LEFT JOIN irregular p ON p.series_id = c.series_id AND p.ds = c.ds""")


@query("c1_complete_month", _complete_sql("LIKE", "MONTH"))
def c1_month(spark, d):
    return calendars.complete_calendar(irregular(spark, d).where("series_id LIKE 'Brand%'"), "month")


@query("c1_complete_day", _complete_sql("NOT LIKE", "DAY"))
def c1_day(spark, d):
    return calendars.complete_calendar(irregular(spark, d).where("series_id NOT LIKE 'Brand%'"), "day")


KNOWN = """
known AS (SELECT driver, ds, ROW_NUMBER() OVER (PARTITION BY driver ORDER BY ds) AS step
          FROM driver_long WHERE ds >= DATE '2001-03-01'),
have AS (SELECT driver, COUNT(*) AS n, MAX(ds) AS last FROM known GROUP BY 1)"""


@query("c2_future_dates", sql("""
SELECT driver, ds, step, TRUE AS known FROM known WHERE step <= 12
UNION ALL
SELECT driver, CAST(last + to_months(CAST(i AS INTEGER)) AS DATE), n + i, FALSE
FROM have, (SELECT UNNEST(generate_series(1, 12)) AS i) WHERE n + i <= 12""", KNOWN))
def c2(spark, d):
    return calendars.extended_horizon(star.driver_long(spark, d), MONTHLY_LATE, "driver")


def _next_sql(table: str, unit: str, n: int) -> str:
    return sql(f"""
SELECT series_id, CAST(last + {unit}(CAST(i AS INTEGER)) AS DATE) AS ds
FROM (SELECT series_id, MAX(ds) AS last FROM {table} GROUP BY 1), (SELECT UNNEST(generate_series(1, {n})) AS i)""")


@query("c3_next_months", _next_sql("product_monthly", "to_months", 12))
def c3_month(spark, d):
    return calendars.next_periods(star.product_monthly(spark, d), "month", 12)


@query("c3_next_days", _next_sql("product_daily", "to_days", 7))
def c3_day(spark, d):
    return calendars.next_periods(star.product_daily(spark, d), "day", 7)


@query("c3_next_weeks", _next_sql("product_daily", "to_weeks", 4))
def c3_week(spark, d):
    return calendars.next_periods(star.product_daily(spark, d), "week", 4)


# -- projection and filter --------------------------------------------------------------

@query("p1_choose_columns", sql("SELECT ds, driver, x FROM driver_long WHERE driver IN ('n_orders', 'open_orders')"))
def p1(spark, d):
    return calendars.chosen_drivers(star.driver_long(spark, d), ("n_orders", "open_orders"))


@query("p2_training_window", sql("SELECT series_id, ds, y FROM train", TRAIN))
def p2(spark, d):
    return star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start)


@query("p3_test_window", sql("SELECT series_id, ds, y, step FROM horizon", HORIZON))
def p3(spark, d):
    return calendars.horizon_rows(star.product_monthly(spark, d), MONTHLY)


@query("p4_rename_columns", sql("""
SELECT strftime(ds, '%d-%m-%Y') AS "Date", n_orders AS orders, n_customers AS customers, 0.0::DOUBLE AS scenario
FROM driver_monthly"""))
def p4(spark, d):
    return (
        star.driver_monthly(spark, d).withColumnsRenamed({"n_orders": "orders", "n_customers": "customers"})
        .withColumn("Date", dates.report_date(F.col("ds"))).withColumn("scenario", F.lit(0.0))
        .select("Date", "orders", "customers", "scenario")
    )


def _units(spark, d):
    units = F.explode(F.array(*[F.lit(u) for u in UNIT_LABELS])).alias("unit")
    # Thousandths of a share of the series total: values with many decimals.
    share = F.col("y") / F.sum("y").over(Window.partitionBy("series_id")) * 1000
    return star.product_monthly(spark, d).withColumn("v", share).select("series_id", "ds", "v", units)


UNITS = """
units AS (
  SELECT series_id, ds, v, unit
  FROM (SELECT series_id, ds, 1000 * (y / SUM(y) OVER (PARTITION BY series_id)) AS v FROM product_monthly), (VALUES ('Euro'), ('Stückzahl'), ('einheitslos')) u(unit))"""


@query("p5_unit_rounding", sql("""
SELECT series_id, ds, unit, round_even(v, CASE unit WHEN 'Euro' THEN 2 WHEN 'Stückzahl' THEN 0 ELSE 9 END) AS value
FROM units""", UNITS))
def p5(spark, d):
    return _units(spark, d).select("series_id", "ds", "unit", unit_rounded(F.col("v"), F.col("unit")).alias("value"))


@query("p6_unit_label", sql("""
SELECT series_id, unit, CASE unit WHEN 'Euro' THEN 'in €' WHEN 'Stückzahl' THEN 'in Stk' ELSE '' END AS label
FROM units GROUP BY ALL""", UNITS))
def p6(spark, d):
    return _units(spark, d).select("series_id", "unit", unit_label(F.col("unit")).alias("label")).distinct()


@query("p7_method_selection", sql("SELECT series_id, ds, method, yhat FROM fc WHERE method IN ('last_value')", NAIVE))
def p7(spark, d):
    return assemble.chosen_methods(naive_forecast(spark, d), ("last_value",)).select("series_id", "ds", "method", "yhat")


CORRELATION = """
pairs AS (
  SELECT a.driver AS d1, b.driver AS d2, corr(a.x, b.x) AS r FROM driver_long a JOIN driver_long b ON a.ds = b.ds
  WHERE a.ds >= DATE '1996-01-01' AND a.ds < DATE '2001-07-01' GROUP BY 1, 2)"""


def correlation_frame(spark, d):
    """Training window plus the horizon rows."""
    wide = star.driver_monthly(spark, d)
    return wide.where((F.col("ds") >= F.lit(MONTHLY.train_start)) & (
        F.col("ds") < F.add_months(F.lit(MONTHLY.forecast_start), MONTHLY.horizon)))


@query("p8_threshold", sql("SELECT d1, d2, ROUND(r, 6) AS r FROM pairs WHERE abs(r) >= 0.6", CORRELATION))
def p8(spark, d):
    matrix = explore.correlations(correlation_frame(spark, d), star.DRIVERS)
    return matrix.where(F.abs("r") >= 0.6).withColumn("r", rounded(F.col("r"), 6))


# -- joins ------------------------------------------------------------------------------

@query("j1_outer_alignment", sql("""
SELECT COALESCE(p.ds, m.ds) AS ds, p.y, m.n_orders, m.open_orders
FROM (SELECT ds, SUM(CAST(y AS DECIMAL(18,2)))::DOUBLE AS y FROM product_monthly GROUP BY 1) p
FULL OUTER JOIN driver_monthly m ON p.ds = m.ds"""))
def j1(spark, d):
    total = star.product_monthly(spark, d).groupBy("ds").agg(
        F.sum(F.col("y").cast("decimal(18,2)")).cast("double").alias("y"))
    return assemble.outer_aligned(total, star.driver_monthly(spark, d).select("ds", "n_orders", "open_orders"))


@query("j2_forecast_scenario_merge", sql("""
SELECT f.series_id, f.ds, f.method, f.yhat, s.scenario, ROUND(s.yhat, 4) AS scenario_yhat
FROM fc f JOIN scenario s ON f.series_id = s.series_id AND f.ds = s.ds""", NAIVE, HORIZON, SCENARIO))
def j2(spark, d):
    return assemble.merged_with_scenarios(naive_forecast(spark, d), scenarios(spark, d)).withColumn(
        "scenario_yhat", rounded(F.col("scenario_yhat")))


@query("j3_methods_wide", sql("""
SELECT series_id, ds, MAX(yhat) FILTER (WHERE method = 'seasonal_naive') AS seasonal_naive,
       MAX(yhat) FILTER (WHERE method = 'last_value') AS last_value FROM fc GROUP BY 1, 2""", NAIVE))
def j3(spark, d):
    return assemble.methods_wide(naive_forecast(spark, d), ("seasonal_naive", "last_value"))


@query("j4_horizon_alignment", sql("""
SELECT s.series_id, c.ds, c.step, p.y FROM (SELECT DISTINCT series_id FROM product_monthly) s
CROSS JOIN (SELECT CAST(DATE '2001-03-01' + to_months(CAST(i - 1 AS INTEGER)) AS DATE) AS ds, i AS step
            FROM (SELECT UNNEST(generate_series(1, 12)) AS i)) c
LEFT JOIN product_monthly p ON p.series_id = s.series_id AND p.ds = c.ds"""))
def j4(spark, d):
    product = star.product_monthly(spark, d)
    return calendars.horizon_dates(product, MONTHLY_LATE).join(product, ["series_id", "ds"], "left")


@query("j8_what_if_override", sql("""
SELECT ds, driver, CASE WHEN ds IN (DATE '2000-08-01', DATE '2000-11-01') AND driver = 'n_orders' THEN x * 2 ELSE x END AS x
FROM driver_long WHERE ds >= DATE '2000-07-01' AND ds < DATE '2001-07-01'"""))
def j8(spark, d):
    future = calendars.horizon_rows(star.driver_long(spark, d), MONTHLY, "driver").drop("step")
    edits = future.where((F.col("driver") == "n_orders") & F.col("ds").isin("2000-08-01", "2000-11-01")).select(
        "ds", "driver", (F.col("x") * 2).alias("x"))
    return assemble.with_overrides(future, edits)


@query("j10_semi_join", sql("""
SELECT p.series_id, p.ds, p.y FROM product_monthly p WHERE EXISTS (
  SELECT 1 FROM scenario s WHERE s.series_id = p.series_id AND s.ds = p.ds AND s.scenario = 'plus five')""", HORIZON, SCENARIO))
def j10_semi(spark, d):
    chosen = scenarios(spark, d).where("scenario = 'plus five'").select("series_id", "ds")
    return star.product_monthly(spark, d).join(chosen, ["series_id", "ds"], "left_semi")


@query("j10_anti_join", sql("""
SELECT series_id, ds, y FROM irregular WHERE series_id LIKE 'Brand%' AND series_id IN (
  SELECT series_id FROM irregular WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1 HAVING COUNT(y) = 54)"""))
def j10_anti(spark, d):
    monthly = irregular(spark, d).where("series_id LIKE 'Brand%'")
    blocked = validate.blocked_series(calendars.aligned_calendar(monthly, "month", MONTHLY, "series_id", "y"))
    return monthly.join(blocked, "series_id", "left_anti")


@query("j10_usable_drivers", sql("""
SELECT ds, driver, x FROM driver_long WHERE driver NOT IN ('urgent_orders', 'open_orders')"""))
def j10_drivers(spark, d):
    gap = drivers_with_gap(spark, d)
    blocked = validate.blocked_series(calendars.aligned_calendar(gap, "month", MONTHLY, "driver", "x"), "driver", "x")
    return gap.join(blocked, "driver", "left_anti")


# -- sorting and set operations ---------------------------------------------------------

@query("o1_strongest_first", sql("""
SELECT d1, d2, ROUND(r, 6) AS r, ROW_NUMBER() OVER (ORDER BY ROUND(abs(r), 6) DESC, d1, d2) AS place
FROM pairs WHERE d1 <> d2""", CORRELATION))
def o1(spark, d):
    matrix = explore.correlations(correlation_frame(spark, d), star.DRIVERS).where("d1 <> d2")
    # k * (k - 1) rows: the size is set by the chosen drivers, not by the data.
    order = Window.orderBy(F.round(F.abs("r"), 6).desc(), "d1", "d2")
    return matrix.select("d1", "d2", rounded(F.col("r"), 6).alias("r"), F.row_number().over(order).cast("long").alias("place"))


@query("o4_horizon_limit", sql("""
SELECT series_id, ds, y, step FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS step
  FROM product_daily WHERE ds >= DATE '2024-01-24') WHERE step <= 7"""))
def o4(spark, d):
    return calendars.horizon_rows(star.product_daily(spark, d), DAILY)


@query("u1_train_plus_test", sql("""
SELECT series_id, ds, y, 'train' AS part FROM train UNION ALL SELECT series_id, ds, y, 'test' FROM horizon""", TRAIN, HORIZON))
def u1(spark, d):
    product = star.product_monthly(spark, d)
    return assemble.train_and_test(product, MONTHLY)


@query("u2_methods_and_scenarios", sql("""
SELECT series_id, ds, method, ROUND(yhat, 4) AS yhat FROM fc
UNION ALL SELECT series_id, ds, scenario, ROUND(yhat, 4) FROM scenario""", NAIVE, HORIZON, SCENARIO))
def u2(spark, d):
    out = assemble.methods_and_scenarios(naive_forecast(spark, d).select("series_id", "ds", "method", "yhat"), scenarios(spark, d))
    return out.withColumn("yhat", rounded(F.col("yhat")))


# -- assembly ---------------------------------------------------------------------------

@query("g1_forecast_assembly", sql("""
SELECT series_id, strftime(ds, '%d-%m-%Y') AS "Date",
       MAX(yhat) FILTER (WHERE method = 'last_value') AS last_value,
       MAX(yhat) FILTER (WHERE method = 'seasonal_naive') AS seasonal_naive FROM fc GROUP BY 1, ds""", NAIVE))
def g1(spark, d):
    forecasts = naive_forecast(spark, d).select("series_id", "ds", "method", "yhat")
    parts = [forecasts.where(F.col("method") == m) for m in ("last_value", "seasonal_naive")]
    return assemble.forecast_table(parts, ("last_value", "seasonal_naive"))


@query("g2_actual_vs_forecast", sql("""
SELECT p.series_id, p.ds, p.y, f.last_value, f.seasonal_naive
FROM (SELECT series_id, ds, y FROM train UNION ALL SELECT series_id, ds, y FROM horizon) p
LEFT JOIN (SELECT series_id, ds, MAX(yhat) FILTER (WHERE method = 'last_value') AS last_value,
                  MAX(yhat) FILTER (WHERE method = 'seasonal_naive') AS seasonal_naive FROM fc GROUP BY 1, 2) f
ON p.series_id = f.series_id AND p.ds = f.ds""", TRAIN, HORIZON, NAIVE))
def g2(spark, d):
    wide = assemble.methods_wide(naive_forecast(spark, d), ("last_value", "seasonal_naive"))
    return assemble.actual_and_forecast(star.product_monthly(spark, d), wide, MONTHLY)


@query("g3_run_summary", sql(f"""
SELECT series_id, 'einheitslos' AS unit, '01.01.1996 - 01.07.2000' AS training_span, '12 month' AS horizon,
       '12 month' AS season, '{", ".join(star.DRIVERS)}' AS drivers, '{", ".join(METHODS)}' AS methods,
       COUNT(*) FILTER (WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01') AS train_rows
FROM product_monthly GROUP BY 1"""))
def g3(spark, d):
    return assemble.run_summary(star.product_monthly(spark, d), MONTHLY)

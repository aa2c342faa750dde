"""The methods on the fleet: one series per brand and nation, many of them with gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.catalog.base import MONTHLY, MONTHLY_SPAN, query, sql
from fleetcast.catalog.exploration import _ROUND_PARTS, _parts_sql, _shown
from fleetcast.catalog.linear import FUTURE, OLS, ROWS, STATS, TWO
from fleetcast.config import ELASTIC_NET, HOLT_WINTERS, MLR, RIDGE, SARIMA
from fleetcast.functions.scalars import rounded
from fleetcast.operators import arima, calendars, explore, metrics, regress, smooth
from fleetcast.plans import status
from fleetcast.session import materialize
from fleetcast.sources import star

FLEET_ROWS = ROWS.replace("FROM product_monthly p", "FROM product_fleet p")
# Two observations per coefficient and some spread are needed for a comparable solution; other series are reported without one.
DENSE = 24
STATUS_SQL = f"CASE WHEN n >= {DENSE} THEN 'solved' ELSE 'fewer than {DENSE} training rows' END"
SIZES = """
sizes AS (
  SELECT series_id, COUNT(*) FILTER (WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01') AS n FROM product_fleet
  WHERE ds >= DATE '1996-01-01' AND ds < DATE '2001-07-01' GROUP BY 1)"""


def _status():
    return F.when(F.col("n") >= DENSE, "solved").otherwise(f"fewer than {DENSE} training rows").alias("status")


def _sizes(product):
    """Training rows of every series of the fleet, also of those without any."""
    inside = F.col("ds") < F.lit(TWO.forecast_start)
    return product.groupBy("series_id").agg(F.count_if(inside).alias("n"))


def _inputs(spark, d):
    return materialize(star.product_fleet(spark, d, "nation", *MONTHLY_SPAN), "fleet"), materialize(star.driver_monthly(spark, d, *MONTHLY_SPAN), "drivers")


def _fleet(spark, d):
    return materialize(star.product_fleet(spark, d, "nation", *MONTHLY_SPAN), "fleet")


@query("s4_product_fleet", sql("SELECT series_id, ds, y FROM product_fleet"))
def s4_fleet(spark, d):
    return star.product_fleet(spark, d)


@query("c1_complete_fleet", sql("""
SELECT c.series_id, c.ds, p.y FROM (
  SELECT series_id, UNNEST(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS ds
  FROM (SELECT series_id, MIN(ds) AS lo, MAX(ds) AS hi FROM product_fleet GROUP BY 1)) c
LEFT JOIN product_fleet p ON p.series_id = c.series_id AND p.ds = c.ds"""))
def c1_fleet(spark, d):
    return calendars.complete_calendar(star.product_fleet(spark, d), "month")


@query("d1_decompose_fleet", sql(f"SELECT series_id, ds, {_ROUND_PARTS} FROM parts", _parts_sql("product_fleet", 12)))
def d1_fleet(spark, d):
    return _shown(explore.decompose(star.product_fleet(spark, d), 12))


@query("r1_mlr_fleet", sql("""
SELECT s.series_id, s.n, CASE WHEN s.n >= 24 THEN ROUND(b1, 3) + 0.0 END AS b1, CASE WHEN s.n >= 24 THEN ROUND(b2, 3) + 0.0 END AS b2,
       CASE WHEN s.n >= 24 THEN ROUND(b0, 1) + 0.0 END AS intercept, """ + STATUS_SQL.replace("n >=", "s.n >=") + """ AS status
FROM sizes s LEFT JOIN ols o ON o.series_id = s.series_id""", FLEET_ROWS, STATS, OLS, SIZES))
def r1_fleet(spark, d):
    product, drivers = _inputs(spark, d)
    m = _sizes(product).join(regress.unscaled(regress.fit_linear(product, drivers, TWO, MLR)), "series_id", "left")

    def solved(value):
        return F.when(F.col("n") >= DENSE, value)

    return m.select("series_id", "n", solved(rounded(F.get("raw_coef", F.lit(0)), 3)).alias("b1"),
                    solved(rounded(F.get("raw_coef", F.lit(1)), 3)).alias("b2"), solved(rounded(F.col("raw_intercept"), 1)).alias("intercept"), _status())


@query("a01_mae_fleet", sql("""
SELECT s.series_id, COUNT(f.ds) AS periods, CASE WHEN s.n >= 24 THEN ROUND(AVG(abs(b0 + b1 * x1 + b2 * x2 - p.y)), 2) END AS mae, """
                             + STATUS_SQL.replace("n >=", "s.n >=") + """ AS status
FROM sizes s LEFT JOIN ols o ON o.series_id = s.series_id
LEFT JOIN (product_fleet p JOIN future f ON f.ds = p.ds) ON p.series_id = s.series_id GROUP BY s.series_id, s.n""",
                             FLEET_ROWS, STATS, OLS, FUTURE, SIZES))
def a01_fleet(spark, d):
    product, drivers = _inputs(spark, d)
    forecast = regress.forecast_linear(product, drivers, TWO, MLR).where("kind = 'pred'")
    scored = product.where(F.col("ds") >= F.lit(TWO.forecast_start)).join(forecast.select("series_id", "ds", "yhat"), ["series_id", "ds"], "left").groupBy("series_id").agg(
        F.count("*").alias("periods"), rounded(F.avg(F.abs(metrics.error())), 2).alias("mae"))
    return _sizes(product).join(scored, "series_id", "left").select(
        "series_id", F.coalesce("periods", F.lit(0)).alias("periods"), F.when(F.col("n") >= DENSE, F.col("mae")).alias("mae"), _status())


@query("r3_ridge_fleet")
def r3_fleet(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), MONTHLY, RIDGE)


@query("r6_elastic_net_fleet")
def r6_fleet(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), MONTHLY, ELASTIC_NET)


@query("v10_fleet_usability", sql("""
SELECT series_id, n AS rows, CASE WHEN n = 0 THEN 'no training rows' WHEN last <> DATE '2000-06-01' THEN 'ends before the forecast'
  WHEN n <> date_diff('month', first, DATE '2000-07-01') THEN 'gaps in the training window' END AS reason
FROM (SELECT series_id, COUNT(*) FILTER (WHERE inside) AS n, MIN(ds) FILTER (WHERE inside) AS first, MAX(ds) FILTER (WHERE inside) AS last FROM (
        SELECT series_id, ds, ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' AS inside FROM product_fleet WHERE ds >= DATE '1996-01-01' AND ds < DATE '2001-07-01')
      GROUP BY 1)"""))
def fleet_usability(spark, d):
    """Every series of the fleet with its training rows and why it cannot be forecast, if so."""
    return status.usability(_fleet(spark, d), MONTHLY)


@query("h4_smoothing_fleet")
def h4_fleet(spark, d):
    fleet = _fleet(spark, d)
    return status.with_status(fleet, MONTHLY, smooth.holt_winters(fleet, MONTHLY)[0], HOLT_WINTERS)


@query("x7_sarima_fleet")
def x7_fleet(spark, d):
    fleet = _fleet(spark, d)
    return status.with_status(fleet, MONTHLY, arima.arima(fleet, None, MONTHLY)[0], SARIMA)

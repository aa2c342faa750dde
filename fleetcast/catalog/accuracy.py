"""Error metrics over forecasts that need no model: last value and same month last year."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fleetcast.catalog.base import MONTHLY, MONTHLY_LATE, query, sql
from fleetcast.functions.scalars import rounded
from fleetcast.operators import calendars, metrics
from fleetcast.sources import star


def _with_lags(spark, d):
    w = Window.partitionBy("series_id").orderBy("ds")
    return star.product_monthly(spark, d).withColumns(
        {"seasonal_naive": F.lag("y", 12).over(w), "last_value": F.lag("y", 1).over(w)})


def _by_method(wide):
    """``(series_id, ds, y, method, yhat)``; unpivoting last keeps one window pass per series."""
    return wide.unpivot(["series_id", "ds", "y"], ["seasonal_naive", "last_value"], "method", "yhat")


def naive_forecast(spark, d):
    return _by_method(calendars.horizon_rows(_with_lags(spark, d), MONTHLY))


def naive_fit(spark, d):
    return _by_method(calendars.training(_with_lags(spark, d), MONTHLY))


NAIVE = """
naive AS (
  SELECT series_id, ds, y, 'seasonal_naive' AS method, LAG(y, 12) OVER (PARTITION BY series_id ORDER BY ds) AS yhat FROM product_monthly
  UNION ALL
  SELECT series_id, ds, y, 'last_value', LAG(y, 1) OVER (PARTITION BY series_id ORDER BY ds) FROM product_monthly),
fc AS (
  SELECT series_id, ds, y, method, yhat, yhat - y AS e,
         CASE WHEN y <> 0 THEN 100 * abs(yhat - y) / abs(y) WHEN yhat <> y THEN CAST('Infinity' AS DOUBLE) END AS ape,
         CASE WHEN abs(y) + abs(yhat) <> 0 THEN 200 * abs(yhat - y) / (abs(y) + abs(yhat)) END AS sape,
         CASE WHEN y <> 0 THEN 100 * (yhat - y) / y WHEN yhat <> y THEN sign(yhat - y) * CAST('Infinity' AS DOUBLE) END AS rel
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, method ORDER BY ds) AS rn FROM naive
        WHERE ds >= DATE '2000-07-01') WHERE rn <= 12)"""

# Right-hand sides in SQL, per metric name.
AGGREGATE_SQL = {
    "mae": "ROUND(AVG(abs(e)), 4)",
    "mae_total": "ROUND(abs(SUM(y) - SUM(yhat)), 4)",
    "mae_min": "MIN(ROUND(abs(e), 4))",
    "mae_max": "MAX(ROUND(abs(e), 4))",
    "mse": "ROUND(AVG(e * e), 0)",
    "rmse": "ROUND(sqrt(AVG(e * e)), 4)",
    "smape": "ROUND(AVG(sape), 4)",
    "smape_total": "ROUND(200 * abs(SUM(y) - SUM(yhat)) / (abs(SUM(y)) + abs(SUM(yhat))), 4)",
    "smape_min": "MIN(ROUND(sape, 4))",
    "smape_max": "MAX(ROUND(sape, 4))",
    "mape": "ROUND(AVG(ape), 4)",
    "mape_total": "ROUND(100 * abs(SUM(y) - SUM(yhat)) / abs(SUM(y)), 4)",
    "mape_min": "MIN(ROUND(ape, 4))",
    "mape_max": "MAX(ROUND(ape, 4))",
    "mfe": "ROUND(AVG(e), 4) + 0.0",
    "rel_mfe": "ROUND(AVG(rel), 4) + 0.0",
    "total_bias": "ROUND(SUM(e), 4) + 0.0",
    "rel_total_bias": "ROUND(100 * SUM(e) / SUM(y), 4) + 0.0",
    "nmse": "ROUND(AVG(e * e) / var_samp(y), 4)",
    "theil_u": "ROUND(sqrt(AVG(e * e)) / (sqrt(AVG(yhat * yhat)) + sqrt(AVG(y * y))), 6)",
}
PERIOD_SQL = {
    "mae": "ROUND(abs(e), 4)", "smape": "ROUND(sape, 4)", "mape": "ROUND(ape, 4)",
    "bias": "ROUND(e, 4) + 0.0", "rel_bias": "ROUND(rel, 4) + 0.0",
}
# A group with a missing actual or forecast has no averages.
_GUARD = "CASE WHEN COUNT(*) FILTER (WHERE e IS NULL) = 0 THEN {} END AS {}"


def aggregate_select(names, source: str = "fc") -> str:
    cols = ", ".join(_GUARD.format(AGGREGATE_SQL[n], n) for n in names)
    return f"SELECT series_id, method, {cols} FROM {source} GROUP BY 1, 2"


def period_select(names, source: str = "fc") -> str:
    cols = ", ".join(f"{PERIOD_SQL[n]} AS {n}" for n in names)
    return f"SELECT series_id, method, ds, {cols} FROM {source}"


def _score(names):
    def run(spark, d):
        # Squares of amounts have no comparable decimals, and Theil's U is unrounded.
        digits = {"mse": 0, "theil_u": 6}
        out = metrics.score(naive_forecast(spark, d), names)
        return out.withColumns({n: rounded(F.col(n), digits[n]) for n in names if n in digits})
    return run


def _periods(names):
    return lambda spark, d: metrics.score_periods(naive_forecast(spark, d), names)


AGGREGATES = {
    "a01_mae": ("mae",), "a02_mae_total": ("mae_total",), "a04_mse": ("mse",), "a05_rmse": ("rmse",),
    "a06_smape": ("smape",), "a07_smape_total": ("smape_total",), "a09_mape": ("mape",),
    "a10_mape_total": ("mape_total",), "a12_mfe": ("mfe",), "a13_rel_mfe": ("rel_mfe",),
    "a14_total_bias": ("total_bias",), "a15_rel_total_bias": ("rel_total_bias",), "a18_nmse": ("nmse",),
    "a19_theil_u": ("theil_u",),
    "a03_mae_min_max": ("mae_min", "mae_max"), "a08_smape_min_max": ("smape_min", "smape_max"),
    "a11_mape_min_max": ("mape_min", "mape_max"),
    "a20_metric_report": tuple(AGGREGATE_SQL),
}
PERIODS = {
    "a03_mae_per_period": ("mae",), "a08_smape_per_period": ("smape",), "a11_mape_per_period": ("mape",),
    "a16_bias_per_period": ("bias",), "a17_rel_bias_per_period": ("rel_bias",),
    "a20_period_report": tuple(PERIOD_SQL),
}
for _name, _metrics in sorted(AGGREGATES.items()):
    query(_name, sql(aggregate_select(_metrics), NAIVE))(_score(_metrics))
for _name, _metrics in sorted(PERIODS.items()):
    query(_name, sql(period_select(_metrics), NAIVE))(_periods(_metrics))


FIT = """
fit AS (
  SELECT series_id, ds, y, method, yhat, yhat - y AS e, 100 * abs(yhat - y) / abs(y) AS ape,
         200 * abs(yhat - y) / (abs(y) + abs(yhat)) AS sape
  FROM naive WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01')"""


@query("a21_fit_report", sql(aggregate_select(metrics.FIT_METRICS, "fit"), NAIVE, FIT))
def a21(spark, d):
    return metrics.score(naive_fit(spark, d), metrics.FIT_METRICS)


LATE = """
late AS (
  SELECT h.series_id, h.ds, h.method, p.y, h.yhat, h.yhat - p.y AS e,
         100 * abs(h.yhat - p.y) / abs(p.y) AS ape,
         200 * abs(h.yhat - p.y) / (abs(p.y) + abs(h.yhat)) AS sape, 100 * (h.yhat - p.y) / p.y AS rel
  FROM (SELECT series_id, CAST(ds + INTERVAL 12 MONTH AS DATE) AS ds, 'seasonal_naive' AS method, y AS yhat
        FROM product_monthly WHERE ds >= DATE '2000-03-01' AND ds <= DATE '2001-02-01') h
  LEFT JOIN product_monthly p ON p.series_id = h.series_id AND p.ds = h.ds)"""


@query("a20_incomplete_horizon", sql(aggregate_select(("mae", "mape", "smape", "mfe", "mae_min", "mape_max"), "late"), LATE))
def a20_incomplete(spark, d):
    """The horizon runs past the last actual: every metric of such a series is NULL."""
    product = star.product_monthly(spark, d)
    dates = calendars.horizon_dates(product, MONTHLY_LATE)
    year_before = product.select("series_id", F.add_months("ds", 12).alias("ds"), F.col("y").alias("yhat"))
    joined = (
        dates.join(year_before, ["series_id", "ds"]).join(product, ["series_id", "ds"], "left")
        .withColumn("method", F.lit("seasonal_naive"))
    )
    return metrics.score(joined, ("mae", "mape", "smape", "mfe", "mae_min", "mape_max"))

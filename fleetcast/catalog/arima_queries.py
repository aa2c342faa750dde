"""Differencing orders, criteria, driver subsets, and the seasonal ARIMA methods."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fleetcast.catalog.accuracy import naive_fit
from fleetcast.catalog.base import DAILY, MONTHLY, daily_input, eliminated, product_input, query, series_inputs, sql
from fleetcast.catalog.linear import OLS, ROWS, STATS, TWO
from fleetcast.config import SARIMA, SARIMAX
from fleetcast.functions.scalars import rounded
from fleetcast.operators import arima, gram, roots
from fleetcast.sources import star


def _packed(spark, d, method, config=MONTHLY):
    product, drivers = series_inputs(spark, d) if method == SARIMAX else (product_input(spark, d), None)
    names = config.drivers if method == SARIMAX else ()
    frame = arima.regression_frame(product, drivers, config, method)
    return arima.frame_moments(frame, len(arima.feature_names(names, config.season_length)))


# Series with a value for every month of the training window.
COMPLETE = """
complete AS (
  SELECT series_id, ds, y FROM product_monthly WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01'
  WINDOW s AS (PARTITION BY series_id)
  QUALIFY COUNT(*) OVER s = date_diff('month', MIN(ds) OVER s, DATE '2000-07-01') AND MAX(ds) OVER s = DATE '2000-06-01')"""

# Levels 0 and 1 of each series, standardized.
PLAIN_LEVELS = """
plain AS (
  SELECT series_id || '|' || level AS key, series_id, level, row_number() OVER w AS t, COUNT(*) OVER (PARTITION BY series_id, level) AS n,
         (y - AVG(y) OVER g) / stddev_pop(y) OVER g AS y
  FROM (SELECT series_id, 0 AS level, ds, y FROM complete
        UNION ALL SELECT series_id, 1, ds, y - LAG(y) OVER (PARTITION BY series_id ORDER BY ds) FROM complete)
  WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id, level ORDER BY ds), g AS (PARTITION BY series_id, level)),
adf_rows AS (
  SELECT key, series_id, level, n, k, [1, y1, t / n, d1, IF(k > 2, d2, 0), IF(k > 3, d3, 0), y - y1] AS z FROM (
    SELECT *, CAST(floor(round(power(n - 1, 1 / 3.0), 9)) AS BIGINT) + 1 AS k, LAG(y) OVER w AS y1, LAG(y) OVER w - LAG(y, 2) OVER w AS d1,
           LAG(y, 2) OVER w - LAG(y, 3) OVER w AS d2, LAG(y, 3) OVER w - LAG(y, 4) OVER w AS d3 FROM plain WINDOW w AS (PARTITION BY key ORDER BY t))
  WHERE t > k),
adf_m AS (SELECT key, i, j, SUM(z[i + 1] * z[j + 1]) AS v FROM adf_rows, range(7) a(i), range(7) b(j) GROUP BY ALL),
adf_e AS (SELECT key, i, j, v FROM adf_m WHERE i < 6 UNION ALL SELECT DISTINCT key, i, 7, IF(i = 1, 1.0, 0.0) FROM adf_m WHERE i < 6),
pp_rows AS (SELECT key, series_id, level, n - 1 AS n, t - 1 AS t, [1, t - 1, LAG(y) OVER (PARTITION BY key ORDER BY t), y] AS z FROM plain),
pp_m AS (SELECT key, i, j, SUM(z[i + 1] * z[j + 1]) AS v FROM pp_rows, range(4) a(i), range(4) b(j) WHERE t > 0 GROUP BY ALL),
pp_e AS (SELECT * FROM pp_m WHERE i < 3)"""

UNIT_ROOTS = """
adf AS (
  SELECT r.key, ANY_VALUE(b) / sqrt(((SELECT v FROM adf_m m WHERE m.key = r.key AND i = 6 AND j = 6) - ANY_VALUE(bc)) / (COUNT(*) - 6) * ANY_VALUE(inv)) AS adf
  FROM adf_rows r JOIN (
    SELECT s.key, MAX(s.v) FILTER (WHERE s.i = 1 AND s.j = 6) AS b, MAX(s.v) FILTER (WHERE s.i = 1 AND s.j = 7) AS inv, SUM(s.v * c.v) FILTER (WHERE s.j = 6) AS bc
    FROM adf_s s JOIN adf_m c ON c.key = s.key AND c.i = s.i AND c.j = 6 GROUP BY 1) x ON x.key = r.key GROUP BY 1),
pp_u AS (
  SELECT r.*, z[4] - b0 - b1 * z[2] - b2 * z[3] AS u, b2 FROM pp_rows r
  JOIN (SELECT key, MAX(v) FILTER (WHERE i = 0) AS b0, MAX(v) FILTER (WHERE i = 1) AS b1, MAX(v) FILTER (WHERE i = 2) AS b2 FROM pp_s WHERE j = 3 GROUP BY 1) s ON s.key = r.key
  WHERE t > 0),
pp_lags AS (
  SELECT a.key, a.n, b.t - a.t AS j, SUM(a.u * b.u) AS g FROM pp_u a JOIN pp_u b ON b.key = a.key AND b.t - a.t BETWEEN 0 AND floor(4 * power(a.n / 100, 0.25)) GROUP BY ALL),
pp AS (
  SELECT key, ANY_VALUE(n) AS n, SUM(g) FILTER (WHERE j = 0) / ANY_VALUE(n) AS var,
         2 / ANY_VALUE(n) * SUM((1 - j / (floor(4 * power(n / 100, 0.25)) + 1)) * g) FILTER (WHERE j > 0) AS more FROM pp_lags GROUP BY 1),
pp_sums AS (SELECT key, SUM(z[3]) AS s, SUM(z[3] * t) AS st, SUM(z[3] ^ 2) AS ss, ANY_VALUE(b2) AS b FROM pp_u GROUP BY 1)"""

CH = """
seasonal AS (
  SELECT series_id || '|' || level AS key, series_id, level, row_number() OVER (PARTITION BY series_id, level ORDER BY ds) AS t, COUNT(*) OVER (PARTITION BY series_id, level) AS n, y
  FROM (SELECT series_id, 0 AS level, ds, y FROM complete
        UNION ALL SELECT series_id, 1, ds, y - LAG(y, 12) OVER w FROM complete WINDOW w AS (PARTITION BY series_id ORDER BY ds)
        UNION ALL SELECT series_id, 2, ds, y - 2 * LAG(y, 12) OVER w + LAG(y, 24) OVER w FROM complete WINDOW w AS (PARTITION BY series_id ORDER BY ds)) WHERE y IS NOT NULL),
ch_u AS (
  SELECT key, n, t, i, ((t - 1) % 12 = i)::INT * e - e / 12 AS u FROM (
    SELECT *, (y - AVG(y) OVER (PARTITION BY key, (t - 1) % 12)) / 1000 AS e FROM seasonal), range(11) a(i)),
ch_f AS (SELECT key, t, i, SUM(u) OVER (PARTITION BY key, i ORDER BY t) AS f FROM ch_u),
ch_a AS (
  SELECT a.key, a.t, a.i, SUM((1 - abs(a.t - b.t) / (round(12 * power(a.n / 100, 0.25)) + 1)) * b.u) AS a
  FROM ch_u a JOIN ch_u b ON b.key = a.key AND b.i = a.i AND abs(a.t - b.t) <= round(12 * power(a.n / 100, 0.25)) GROUP BY ALL),
ch_e AS (
  SELECT u.key, u.i, a.i AS j, SUM(u.u * a.a) AS v FROM ch_u u JOIN ch_a a ON a.key = u.key AND a.t = u.t GROUP BY ALL
  UNION ALL SELECT x.key, x.i, y.i + 11, SUM(x.f * y.f) FROM ch_f x JOIN ch_f y ON y.key = x.key AND y.t = x.t GROUP BY ALL)"""

CH_STATS = """
ch AS (
  SELECT s.series_id, s.level, s.n, x.v / s.n AS statistic FROM (SELECT DISTINCT key, series_id, level, n FROM seasonal) s
  JOIN (SELECT key, SUM(v) AS v FROM ch_s WHERE j = i + 11 GROUP BY 1) x ON x.key = s.key WHERE s.n >= 24)"""


@query("x1_unit_root_orders")
def x1(spark, d):
    return arima.differencing_orders(star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start), MONTHLY, arima.MAX_D[SARIMA])


@query("x1_unit_root_statistics", sql("""
SELECT l.series_id, CAST(l.level AS BIGINT) AS level, l.n, ROUND(adf, 5) AS adf,
       ROUND(pp.n * (b - 1) - pp.n ^ 6 / (24 * (pp.n ^ 2 * (pp.n ^ 2 - 1) * ss / 12 - pp.n * st ^ 2 + pp.n * (pp.n + 1) * st * s - pp.n * (pp.n + 1) * (2 * pp.n + 1) * s ^ 2 / 6)) * more, 4) AS pp
FROM (SELECT DISTINCT key, series_id, level, n FROM plain) l JOIN adf ON adf.key = l.key JOIN pp ON pp.key = l.key JOIN pp_sums q ON q.key = l.key""",
                                      COMPLETE, PLAIN_LEVELS, *eliminated("adf_s", "adf_e", 6), *eliminated("pp_s", "pp_e", 3), UNIT_ROOTS))
def x1_statistics(spark, d):
    """Both unit-root statistics of the series and of their first differences."""
    rows, longest = arima.complete_rows(star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start), MONTHLY)
    return roots.unit_roots(rows, 2, longest).select("series_id", F.col("level").cast("long").alias("level"), "n", rounded(F.col("adf"), 5).alias("adf"), rounded(F.col("pp"), 4).alias("pp"))


@query("x1b_seasonal_statistics", sql("SELECT series_id, CAST(level AS BIGINT) AS level, n, ROUND(statistic, 6) AS statistic FROM ch",
                                      COMPLETE, CH, *eliminated("ch_s", "ch_e", 11), CH_STATS))
def x1b_statistics(spark, d):
    """Canova-Hansen statistics of the series and of their seasonal differences."""
    rows, longest = arima.complete_rows(star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start), MONTHLY)
    stats = roots.seasonal_stability(rows, 12, 3, longest).where("statistic IS NOT NULL")
    return stats.select("series_id", F.col("level").cast("long").alias("level"), "n", rounded(F.col("statistic"), 6).alias("statistic"))


@query("x1b_seasonal_order", sql("""
SELECT c.series_id, ROUND(MAX(statistic) FILTER (WHERE level = 0), 6) AS ch,
       CAST(CASE WHEN MAX(statistic) FILTER (WHERE level = 0) <= 2.7391007 OR COALESCE(MAX(ch.n) FILTER (WHERE level = 0), 0) < 36 THEN 0
                 WHEN COALESCE(MAX(statistic) FILTER (WHERE level = 1), 0) <= 2.7391007 THEN 1
                 WHEN COALESCE(MAX(statistic) FILTER (WHERE level = 2), 0) <= 2.7391007 THEN 2 ELSE 3 END AS BIGINT) AS seasonal_d
FROM (SELECT DISTINCT series_id FROM complete) c LEFT JOIN ch ON ch.series_id = c.series_id GROUP BY 1""",
                                 COMPLETE, CH, *eliminated("ch_s", "ch_e", 11), CH_STATS))
def x1b(spark, d):
    return arima.differencing_orders(star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start), MONTHLY, arima.MAX_D[SARIMA]).select(
        "series_id", rounded(F.col("ch"), 6).alias("ch"), F.col("seasonal_d").cast("long").alias("seasonal_d"))


# Moments of the centered first difference with its lags 1, 12 and 13, and Gauss-Newton steps for the two factors.
PRODUCT = """
diffs AS (
  SELECT series_id, ds, w - AVG(w) OVER (PARTITION BY series_id) AS w FROM (
    SELECT series_id, ds, y - LAG(y) OVER (PARTITION BY series_id ORDER BY ds) AS w FROM complete) WHERE w IS NOT NULL),
lagged AS (
  SELECT series_id, w, COALESCE(LAG(w) OVER s, 0) AS a, COALESCE(LAG(w, 12) OVER s, 0) AS b, COALESCE(LAG(w, 13) OVER s, 0) AS c
  FROM diffs WINDOW s AS (PARTITION BY series_id ORDER BY ds)),
sums AS (
  SELECT series_id, COUNT(*) AS n, SUM(w * w) AS ww, SUM(a * w) AS aw, SUM(b * w) AS bw, SUM(c * w) AS cw, SUM(a * a) AS aa, SUM(b * b) AS bb, SUM(c * c) AS cc,
         SUM(a * b) AS ab, SUM(a * c) AS ac, SUM(b * c) AS bc FROM lagged GROUP BY 1),
steps AS (
  SELECT s.*, 0 AS step, (aw * bb - bw * ab) / (aa * bb - ab * ab) AS p, (bw * aa - aw * ab) / (aa * bb - ab * ab) AS q FROM sums s
  UNION ALL
  SELECT * EXCLUDE (step, p, q, n1, n2, n12, g1, g2), step + 1, p + (g1 * n2 - g2 * n12) / (n1 * n2 - n12 * n12), q + (g2 * n1 - g1 * n12) / (n1 * n2 - n12 * n12) FROM (
    SELECT *, aa - 2 * q * ac + q * q * cc AS n1, bb - 2 * p * bc + p * p * cc AS n2, ab - p * ac - q * bc + p * q * cc AS n12,
           aw - q * cw - (p * aa + q * ab - p * q * ac) + q * (p * ac + q * bc - p * q * cc) AS g1,
           bw - p * cw - (p * ab + q * bb - p * q * bc) + p * (p * ac + q * bc - p * q * cc) AS g2
    FROM steps WHERE step < 200))"""


@query("x2_product_order", sql("""
SELECT series_id, n, ROUND(p, 4) + 0.0 AS phi, ROUND(q, 4) + 0.0 AS seasonal_phi,
       ROUND(ln((ww - 2 * (p * aw + q * bw - p * q * cw) + p * p * aa + q * q * bb + p * p * q * q * cc + 2 * p * q * ab - 2 * p * p * q * ac - 2 * p * q * q * bc) / n), 4) AS log_variance
FROM steps WHERE step = 200""", COMPLETE, PRODUCT))
def x2_product(spark, d):
    """One seasonal order, (1, 1, 0)(1, 0, 0), fitted as a product of lag polynomials to every series."""
    fits = arima.given_order(product_input(spark, d), MONTHLY, 1, 0, (1, 0, 1, 0))
    names = arima.parameter_names((), MONTHLY.season_length)
    return fits.select("series_id", "n", rounded(F.get("params", F.lit(names.index("ar.L1"))), 4).alias("phi"),
                       rounded(F.get("params", F.lit(names.index("ar.S.L12"))), 4).alias("seasonal_phi"), rounded(F.ln(F.col("sse") / F.col("n")), 4).alias("log_variance"))


@query("x2_sarima_candidates")
def x2(spark, d):
    return arima.candidates(_packed(spark, d, SARIMA), MONTHLY.season_length, 0)


@query("x3_sarimax_candidates")
def x3(spark, d):
    return arima.candidates(_packed(spark, d, SARIMAX), MONTHLY.season_length, len(MONTHLY.drivers))


# Errors of two forecasts that need no model: given squared errors, all criteria follow.
GIVEN = """
given AS (
  SELECT series_id, method, SUM((yhat - y) ^ 2) AS sse, COUNT(*) AS n, CASE method WHEN 'last_value' THEN 1 ELSE 13 END AS k,
         SUM((yhat - y) ^ 2) FILTER (WHERE ds >= DATE '1999-07-01') / 12 AS oob
  FROM (SELECT series_id, ds, y, 'seasonal_naive' AS method, LAG(y, 12) OVER (PARTITION BY series_id ORDER BY ds) AS yhat FROM product_monthly
        UNION ALL SELECT series_id, ds, y, 'last_value', LAG(y, 1) OVER (PARTITION BY series_id ORDER BY ds) FROM product_monthly)
  WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1, 2)"""


@query("x4_selection_criteria", sql("""
SELECT series_id, method, ROUND(n * ln(sse / n) + 2 * k, 4) AS aic,
       ROUND(n * ln(sse / n) + 2 * k + 2.0::DOUBLE * k * (k + 1) / (n - k - 1), 4) AS aicc,
       ROUND(n * ln(sse / n) + k * ln(n), 4) AS bic, ROUND(oob, 0) AS oob FROM given""", GIVEN))
def x4(spark, d):
    rows = naive_fit(spark, d).withColumn("sq", F.pow(F.col("yhat") - F.col("y"), F.lit(2.0)))
    given = rows.groupBy("series_id", "method").agg(
        F.sum("sq").alias("sse"), F.count("*").alias("n"),
        (F.sum(F.when(F.col("ds") >= "1999-07-01", F.col("sq"))) / arima.OUT_OF_SAMPLE).alias("oob"),
    ).withColumn("k", F.when(F.col("method") == "last_value", 1).otherwise(13))
    return given.select("series_id", "method", *[
        rounded(arima.criterion_column(c), 0 if c == "oob" else 4).alias(c) for c in arima.CRITERIA])


@query("x5_driver_subsets", sql("""
SELECT series_id, arg_min(mask, aic) AS driver_mask, ROUND(MIN(aic), 4) AS criterion FROM (
  SELECT series_id, mask, n * ln(sse / n) + 2 * (2 + bit_count(mask)) AS aic FROM (
    SELECT series_id, n, UNNEST([0, 1, 2, 3]::BIGINT[]) AS mask,
           UNNEST([n * vy, n * (vy - c1y * c1y / v1), n * (vy - c2y * c2y / v2), n * (vy - b1 * c1y - b2 * c2y)]) AS sse FROM ols))
GROUP BY 1""", ROWS, STATS, OLS))
def x5(spark, d):
    product = star.product_monthly(spark, d, TWO.train_start, TWO.forecast_start)
    rows, names = gram.design(product, star.driver_monthly(spark, d), TWO)
    centered = gram.scaled(rows, names)
    packed = gram.series_moments(centered, [*[f"_z{i}" for i in range(len(names))], "_y"])
    return arima.best_driver_subset(packed, names).select(
        "series_id", F.col("driver_mask").cast("long").alias("driver_mask"), rounded(F.col("criterion")).alias("criterion"))


@query("x5_sarimax_best_subset")
def x5_search(spark, d):
    models = arima.search(_packed(spark, d, SARIMAX, TWO), TWO.season_length, 2, "aic", subsets=True)
    return models.select("series_id", "d", "seasonal_d", "p", "q", "sp", "sq", "trend", "driver_mask", "criterion")


@query("x6_sarima_parameters")
def x6(spark, d):
    return arima.arima(product_input(spark, d), None, MONTHLY)[1]


@query("x6_sarimax_parameters")
def x6_drivers(spark, d):
    return arima.arima(*series_inputs(spark, d), MONTHLY)[1]


@query("x7_sarima_forecast")
def x7(spark, d):
    return arima.arima(product_input(spark, d), None, MONTHLY)[0]


@query("x7_sarimax_forecast")
def x7_drivers(spark, d):
    return arima.arima(*series_inputs(spark, d), MONTHLY)[0]


@query("x7_sarima_out_of_sample")
def x7_oob(spark, d):
    return arima.arima(product_input(spark, d), None, replace(MONTHLY, criterion="oob"))[0]


@query("x7_sarima_daily")
def x7_daily(spark, d):
    return arima.arima(daily_input(spark, d), None, DAILY)[0]


@query("r10_sarimax_contributions")
def r10_sarimax(spark, d):
    """Driver contributions to fits and forecasts of the model with exogenous variables, on the level of the series."""
    return arima.driver_contributions(*series_inputs(spark, d), MONTHLY)

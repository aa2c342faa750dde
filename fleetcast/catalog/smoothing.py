"""Exponential smoothing and the selection of configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.catalog.accuracy import NAIVE, naive_forecast
from fleetcast.catalog.base import DAILY, MONTHLY, daily_input, product_input, query, sql
from fleetcast.functions.scalars import rounded
from fleetcast.operators import calendars, metrics, smooth
from fleetcast.sources import star

M = 12


def _values() -> str:
    def text(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()
    rows = ", ".join(
        f"({c['config_id']}, {text(c['trend'])}, {text(c['damped'])}, {text(c['season'])}, {text(c['box_cox'])}, "
        f"{smooth.parameter_count(c, M)})" for c in smooth.configurations())
    return f"cfg(config_id, trend, damped, season, box_cox, k) AS (SELECT * FROM (VALUES {rows}))"


GRID = _values() + """,
par AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY config_id ORDER BY alpha, beta, gamma, phi) AS pid FROM (
    SELECT config_id, trend, damped, season, box_cox, k,
           UNNEST([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS alpha, beta, gamma, phi FROM (
      SELECT *, UNNEST(CASE WHEN trend IS NULL THEN [0.0] ELSE [0.01, 0.1, 0.3] END::DOUBLE[]) AS beta FROM (
        SELECT *, UNNEST(CASE WHEN season IS NULL THEN [0.0] ELSE [0.01, 0.1, 0.3] END::DOUBLE[]) AS gamma FROM (
          SELECT *, UNNEST(CASE WHEN damped THEN [0.9, 0.98] ELSE [1.0] END::DOUBLE[]) AS phi FROM cfg)))))"""
ARRAYS = """
lam AS (
  SELECT series_id, arg_max(lam, llf) AS lam FROM (
    SELECT series_id, lam, -COUNT(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END))
           + (lam - 1) * SUM(ln(y)) AS llf
    FROM product_monthly, (SELECT -1 + 0.25::DOUBLE * i AS lam FROM (SELECT UNNEST(generate_series(0, 12)) AS i))
    WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1, 2) GROUP BY 1),
ys AS (
  SELECT series_id, list(y ORDER BY ds) AS y, list(ds ORDER BY ds) AS ds, COUNT(*) AS n FROM product_monthly
  WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1 HAVING COUNT(*) = date_diff('month', MIN(ds), DATE '2000-07-01') AND MAX(ds) = DATE '2000-06-01'),
arr AS (
  SELECT ys.series_id, n, FALSE AS box_cox, NULL::DOUBLE AS lam, y AS z FROM ys
  UNION ALL
  SELECT ys.series_id, n, TRUE, lam, list_transform(y, lambda v: CASE WHEN lam = 0 THEN ln(v) ELSE (pow(v, lam) - 1) / lam END)
  FROM ys JOIN lam ON ys.series_id = lam.series_id),
starts AS (
  SELECT *, list_avg(z[1:12]) AS m1, list_avg(z[13:24]) AS m2 FROM arr),
rec AS (
  SELECT s.series_id, p.config_id, p.pid, 0 AS t, m1 AS l,
         CASE p.trend WHEN 'add' THEN (m2 - m1) / 12 WHEN 'mul' THEN pow(m2 / m1, 1 / 12::DOUBLE) ELSE 0.0::DOUBLE END AS tr,
         CASE p.season WHEN 'add' THEN list_transform(z[1:12], lambda v: v - m1) WHEN 'mul' THEN list_transform(z[1:12], lambda v: v / m1)
              ELSE [0.0::DOUBLE] END AS s, 0::DOUBLE AS sse, 0::DOUBLE AS raw, NULL::DOUBLE AS shown
  FROM starts s JOIN par p ON s.box_cox = p.box_cox
  WHERE NOT ((p.trend IS NOT DISTINCT FROM 'mul' OR p.season IS NOT DISTINCT FROM 'mul') AND list_min(z) <= 0)
  UNION ALL
  SELECT series_id, config_id, pid, t + 1, nl,
         CASE trend WHEN 'add' THEN beta * (nl - l) + (1 - beta) * phi * tr
                    WHEN 'mul' THEN beta * nl / l + (1 - beta) * pow(tr, phi) ELSE tr END,
         CASE season WHEN 'add' THEN list_append(s[2:], gamma * (y - q) + (1 - gamma) * head)
                     WHEN 'mul' THEN list_append(s[2:], gamma * y / q + (1 - gamma) * head) ELSE s END,
         sse + (y - f) * (y - f), raw + (back_y - back_f) * (back_y - back_f), back_f
  FROM (
    SELECT *, alpha * base + (1 - alpha) * q AS nl,
           CASE WHEN NOT box_cox THEN f WHEN lam = 0 THEN exp(f) ELSE pow(f * lam + 1, 1 / lam) END AS back_f,
           CASE WHEN NOT box_cox THEN y WHEN lam = 0 THEN exp(y) ELSE pow(y * lam + 1, 1 / lam) END AS back_y
    FROM (
      SELECT *, CASE season WHEN 'add' THEN q + head WHEN 'mul' THEN q * head ELSE q END AS f,
             CASE season WHEN 'add' THEN y - head WHEN 'mul' THEN y / head ELSE y END AS base
      FROM (
        SELECT r.*, p.trend, p.season, p.box_cox, p.alpha, p.beta, p.gamma, p.phi, a.lam, a.z[r.t + 1] AS y, r.s[1] AS head,
               CASE p.trend WHEN 'add' THEN r.l + p.phi * r.tr WHEN 'mul' THEN r.l * pow(r.tr, p.phi) ELSE r.l END AS q
        FROM rec r JOIN par p ON r.config_id = p.config_id AND r.pid = p.pid
        JOIN arr a ON a.series_id = r.series_id AND a.box_cox = p.box_cox WHERE r.t < a.n)))),
fits AS (
  SELECT r.series_id, r.config_id, r.pid, p.alpha, p.beta, p.gamma, p.phi, a.lam, a.n, r.l, r.tr, r.s, r.raw,
         p.trend, p.season, p.box_cox, a.n * ln(r.raw / a.n) + 2 * p.k AS aic
  FROM rec r JOIN par p ON r.config_id = p.config_id AND r.pid = p.pid
  JOIN arr a ON a.series_id = r.series_id AND a.box_cox = p.box_cox AND a.n = r.t
  WHERE isfinite(r.sse) AND isfinite(r.raw)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY r.series_id, r.config_id ORDER BY r.sse, r.pid) = 1),
best AS (
  SELECT * FROM fits QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY aic, config_id) = 1)"""


def _fits(spark, d):
    packed = smooth.packed_series(product_input(spark, d), MONTHLY)
    return packed, smooth.fit_configurations(packed, MONTHLY, zoom_rounds=0, start_rounds=0)


@query("h1_configuration_grid", sql("""
SELECT DISTINCT series_id, config_id, trend, damped, season, box_cox FROM product_monthly, cfg""", GRID))
def h1(spark, d):
    series = star.product_monthly(spark, d).select("series_id").distinct()
    return smooth.with_configurations(series).withColumn("config_id", F.col("config_id").cast("long"))


@query("j6_series_times_configurations", sql("""
SELECT series_id, COUNT(DISTINCT config_id) AS configurations, MIN(n) AS train_rows FROM (
  SELECT series_id, config_id, COUNT(*) AS n FROM product_monthly, cfg
  WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1, 2) GROUP BY 1""", GRID))
def j6(spark, d):
    """Configurations are generated per series row, after the rows of a series became one."""
    sizes = calendars.training(star.product_monthly(spark, d), MONTHLY).groupBy("series_id").agg(F.count("*").alias("n"))
    return smooth.with_configurations(sizes).groupBy("series_id").agg(
        F.count("config_id").alias("configurations"), F.min("n").alias("train_rows"))


@query("u4_parameter_grid", sql("""
SELECT series_id, config_id, COUNT(*) AS candidates, ROUND(SUM(alpha), 6) AS alpha_sum, ROUND(SUM(phi), 6) AS phi_sum
FROM (SELECT DISTINCT series_id FROM product_monthly), par GROUP BY 1, 2""", GRID))
def u4(spark, d):
    """Cartesian parameter values of every configuration, generated per series."""
    series = star.product_monthly(spark, d).select("series_id").distinct()
    points = smooth.with_parameters(smooth.with_configurations(series))
    return points.groupBy("series_id", F.col("config_id").cast("long").alias("config_id")).agg(
        F.count("*").alias("candidates"), F.round(F.sum("alpha"), 6).alias("alpha_sum"), F.round(F.sum("phi"), 6).alias("phi_sum"))


@query("w9_smoothing_fold", sql("""
SELECT series_id, ROUND(sse, 0) AS sse, ROUND(l, 3) AS level, ROUND(tr, 4) + 0.0 AS slope, ROUND(s[1], 3) + 0.0 AS next_season
FROM (SELECT r.* FROM rec r JOIN par p ON r.config_id = p.config_id AND r.pid = p.pid
      WHERE r.config_id = 7 AND p.alpha = 0.3 AND p.beta = 0.1 AND p.gamma = 0.1) w
JOIN ys USING (series_id) WHERE w.t = ys.n""", GRID, ARRAYS))
def w9(spark, d):
    packed = smooth.packed_series(product_input(spark, d), MONTHLY)
    return smooth.smooth_additive(packed, M, 0.3, 0.1, 0.1).select(
        "series_id", rounded(F.col("sse"), 0).alias("sse"), rounded(F.col("level"), 3).alias("level"),
        rounded(F.col("slope")).alias("slope"), rounded(F.element_at("seasonal", 1), 3).alias("next_season"))


_FIT_COLUMNS = ["series_id", "config_id", "alpha", "beta", "gamma", "phi", "aic"]


def _shown(fits):
    return fits.withColumn("config_id", F.col("config_id").cast("long")).withColumn("aic", rounded(F.col("aic")))


@query("h2_smoothing_fits", sql("""
SELECT series_id, config_id, alpha, beta, gamma, phi, ROUND(aic, 4) + 0.0 AS aic FROM fits""", GRID, ARRAYS))
def h2(spark, d):
    return _shown(_fits(spark, d)[1]).select(*_FIT_COLUMNS)


@query("o3_configuration_ranking", sql("""
SELECT series_id, config_id, ROUND(aic, 4) + 0.0 AS aic, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY aic, config_id) AS place
FROM fits""", GRID, ARRAYS))
def o3(spark, d):
    return _shown(smooth.ranked(_fits(spark, d)[1])).select("series_id", "config_id", "aic", "place")


@query("h3_best_configuration", sql("""
SELECT series_id, config_id, alpha, beta, gamma, phi, ROUND(aic, 4) + 0.0 AS aic FROM best""", GRID, ARRAYS))
def h3(spark, d):
    return _shown(smooth.chosen(*_fits(spark, d))).select(*_FIT_COLUMNS)


@query("h4_smoothing_forecast", sql("""

SELECT series_id, CAST(DATE '2000-06-01' + to_months(CAST(h AS INTEGER)) AS DATE) AS ds, 'pred' AS kind,
       ROUND(CASE WHEN NOT box_cox THEN v WHEN lam = 0 THEN exp(v) ELSE pow(v * lam + 1, 1 / lam) END, 2) AS yhat
FROM (SELECT *, CASE season WHEN 'add' THEN base + s[(h - 1) % 12 + 1] WHEN 'mul' THEN base * s[(h - 1) % 12 + 1] ELSE base END AS v
      FROM (SELECT *, CASE trend WHEN 'add' THEN l + damping * tr WHEN 'mul' THEN l * pow(tr, damping) ELSE l END AS base
            FROM (SELECT b.*, h, list_sum(list_transform(generate_series(1, h), lambda i: pow(phi, i))) AS damping
                  FROM best b, (SELECT UNNEST(generate_series(1, 12)) AS h))))
UNION ALL
SELECT b.series_id, y.ds[r.t], 'fit', ROUND(r.shown, 2) FROM best b
JOIN rec r ON r.series_id = b.series_id AND r.config_id = b.config_id AND r.pid = b.pid AND r.t > 0
JOIN ys y ON y.series_id = b.series_id""", GRID, ARRAYS))
def h4(spark, d):
    packed, fits = _fits(spark, d)
    states = smooth.final_states(smooth.chosen(packed, fits), MONTHLY)
    out = smooth.h_step(states, MONTHLY).unionByName(smooth.fitted(states))
    return out.select("series_id", "ds", "kind", rounded(F.col("yhat"), 2).alias("yhat"))


@query("h4_smoothing_parameters")
def h4_parameters(spark, d):
    return smooth.holt_winters(product_input(spark, d), MONTHLY)[1]


@query("h2_smoothing_zoomed")
def h2_zoomed(spark, d):
    packed = smooth.packed_series(product_input(spark, d), MONTHLY)
    return smooth.fit_configurations(packed, MONTHLY)


@query("h2_smoothing_daily")
def h2_daily(spark, d):
    return smooth.holt_winters(daily_input(spark, d), DAILY)[0]


@query("a24_best_method", sql("""
SELECT series_id, method, ROUND(mae, 4) AS mae FROM (
  SELECT series_id, method, AVG(abs(e)) AS mae FROM fc GROUP BY 1, 2)
QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ROUND(mae, 4), method) = 1""", NAIVE))
def a24(spark, d):
    scores = metrics.score(naive_forecast(spark, d), ("mae",))
    return scores.groupBy("series_id").agg(F.min_by(F.struct("method", "mae"), F.struct("mae", "method")).alias("b")).select("series_id", "b.*")

"""Scaling, moments, folds, lag features, and the linear methods."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fleetcast.catalog.accuracy import AGGREGATE_SQL
from fleetcast.catalog.base import MONTHLY, query, series_inputs, sql
from fleetcast.config import ELASTIC_NET, LASSO, MLR, RIDGE
from fleetcast.functions.scalars import rounded
from fleetcast.operators import calendars, gram, metrics, regress, validate, windows
from fleetcast.plans import assemble
from fleetcast.sources import star

# Two drivers have closed forms in SQL; the same code runs any number.
TWO = replace(MONTHLY, drivers=("n_orders", "open_orders"))

ROWS = """
rows2 AS (
  SELECT p.series_id, p.ds, p.y, m.n_orders AS x1, m.open_orders AS x2
  FROM product_monthly p JOIN driver_monthly m ON p.ds = m.ds
  WHERE p.ds >= DATE '1996-01-01' AND p.ds < DATE '2000-07-01')"""
STATS = """
stats AS (
  SELECT series_id, COUNT(*) AS n, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2,
         stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, var_pop(x1) AS v1, var_pop(x2) AS v2, var_pop(y) AS vy,
         covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
  FROM rows2 GROUP BY 1)"""
OLS = """
ols AS (
  SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1,
         (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2,
         my - (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) * m1 - (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) * m2 AS b0
  FROM stats)"""
FUTURE = """
future AS (
  SELECT ds, n_orders AS x1, open_orders AS x2 FROM driver_monthly
  WHERE ds >= DATE '2000-07-01' AND ds < DATE '2001-07-01')"""
# The fixture drivers cover every date, so scoring rows are training rows and horizon dates.
SCORING = """
scoring AS (
  SELECT series_id, ds, x1, x2, 'fit' AS kind FROM rows2
  UNION ALL SELECT s.series_id, f.ds, f.x1, f.x2, 'pred' FROM (SELECT DISTINCT series_id FROM product_monthly) s, future f)"""


_inputs = series_inputs


def _train(spark, d, config=TWO):
    product = star.product_monthly(spark, d, config.train_start, config.forecast_start)
    return gram.design(product, star.driver_monthly(spark, d), config)


# -- moments, scaling, folds, lags ------------------------------------------------------

@query("a25_gram", sql("""
SELECT series_id, COUNT(*)::DOUBLE AS n, SUM(x1) AS s1, SUM(x2) AS s2, ROUND(SUM(y), 2) AS sy, SUM(x1 * x1) AS s11,
       SUM(x1 * x2) AS s12, ROUND(SUM(x1 * y), 2) AS s1y, SUM(x2 * x2) AS s22, ROUND(SUM(x2 * y), 2) AS s2y
FROM rows2 GROUP BY 1""", ROWS))
def a25(spark, d):
    train, names = _train(spark, d)
    packed = gram.series_moments(train, [*names, "y"])
    layout = {"n": None, "s1": None, "s2": None, "sy": 2, "s11": None, "s12": None, "s1y": 2, "s22": None, "s2y": 2}
    cells = {n: F.get("moments", F.lit(i)) for i, n in enumerate(layout)}
    return packed.select("series_id", *[(c if layout[n] is None else rounded(c, layout[n])).alias(n) for n, c in cells.items()])


@query("a26_mean_std", sql("""
SELECT series_id, ROUND(AVG(y), 4) AS mean, ROUND(stddev_pop(y), 4) AS pop_std, ROUND(stddev_samp(y), 4) AS sample_std
FROM product_monthly WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1"""))
def a26(spark, d):
    return star.product_monthly(spark, d, TWO.train_start, TWO.forecast_start).groupBy("series_id").agg(
        rounded(F.avg("y")).alias("mean"), rounded(F.stddev_pop("y")).alias("pop_std"),
        rounded(F.stddev_samp("y")).alias("sample_std"))


@query("r7_standardize", sql("""
SELECT r.series_id, r.ds, ROUND((x1 - m1) / s1, 6) + 0.0 AS n_orders, ROUND((x2 - m2) / s2, 6) + 0.0 AS open_orders
FROM rows2 r JOIN stats s ON r.series_id = s.series_id""", ROWS, STATS))
def r7(spark, d):
    train, names = _train(spark, d)
    return gram.scaled(train, names).select(
        "series_id", "ds", *[rounded(F.col(f"_z{i}"), 6).alias(n) for i, n in enumerate(names)])


@query("w1_lag_features", sql("""
SELECT * FROM (
  SELECT series_id, ds, LAG(x1, 1) OVER w AS "n_orders(t-1)", LAG(x2, 1) OVER w AS "open_orders(t-1)",
         LAG(x1, 3) OVER w AS "n_orders(t-3)", LAG(x2, 3) OVER w AS "open_orders(t-3)",
         x1 AS "n_orders(t)", x2 AS "open_orders(t)"
  FROM rows2 WINDOW w AS (PARTITION BY series_id ORDER BY ds)) WHERE "n_orders(t-3)" IS NOT NULL""", ROWS))
def w1(spark, d):
    train, names = _train(spark, d)
    return windows.lag_features(train.select("series_id", "ds", *names), names, (1, 3))


@query("w2_date_gaps", sql("""
SELECT series_id, ds, LAG(ds) OVER w AS prev_ds, CAST(date_diff('day', LAG(ds) OVER w, ds) AS DOUBLE) AS gap_days
FROM product_monthly WINDOW w AS (PARTITION BY series_id ORDER BY ds)"""))
def w2(spark, d):
    return validate.gaps(star.product_monthly(spark, d)).drop("y").withColumn("gap_days", F.col("gap_days").cast("double"))


@query("w3_nth_rows", sql("""
SELECT series_id, ds, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS from_start,
       ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds DESC) AS from_end FROM product_monthly"""))
def w3(spark, d):
    forward = calendars.position() + 1
    size = F.count("*").over(windows.Window.partitionBy("series_id"))
    return star.product_monthly(spark, d).select(
        "series_id", "ds", forward.cast("long").alias("from_start"), (size - forward + 1).alias("from_end"))


@query("w7_contiguous_folds", sql("""
SELECT series_id, ds, NTILE(5) OVER (PARTITION BY series_id ORDER BY ds) AS fold FROM rows2""", ROWS))
def w7(spark, d):
    train, _ = _train(spark, d)
    return train.select("series_id", "ds", windows.contiguous_fold(5).cast("long").alias("fold"))


@query("w8_walk_forward_folds", sql("""
SELECT series_id, ds, 4 - j AS fold, CASE WHEN block = j THEN 'test' ELSE 'train' END AS role
FROM (SELECT series_id, ds, CAST(ceil(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds DESC) / 12.0) AS BIGINT) AS block FROM rows2)
JOIN (SELECT UNNEST(generate_series(1, 3)) AS j) ON block >= j""", ROWS))
def w8(spark, d):
    train, _ = _train(spark, d)
    return windows.walk_forward(train, 3).select("series_id", "ds", "fold", "role")


# -- least squares ----------------------------------------------------------------------

@query("r1_mlr_coefficients", sql("""
SELECT series_id, UNNEST(['n_orders', 'open_orders', 'Intercept']) AS name,
       UNNEST([ROUND(b1, 4), ROUND(b2, 4), ROUND(b0, 2)]) AS value FROM ols""", ROWS, STATS, OLS))
def r1_coefficients(spark, d):
    models = regress.fit_linear(*_inputs(spark, d), TWO, MLR)
    return regress.parameters(models, TWO.drivers).select(
        "series_id", "name", F.when(F.col("name") == "Intercept", rounded(F.col("value"), 2)).otherwise(rounded(F.col("value"))).alias("value"))


@query("r8_unscaled_coefficients", sql("""
SELECT series_id, ROUND(b1 * s1, 3) AS scaled_1, ROUND(b2 * s2, 3) AS scaled_2, ROUND(b1, 4) AS raw_1,
       ROUND(b2, 4) AS raw_2, ROUND(b0, 2) AS raw_intercept FROM ols""", ROWS, STATS, OLS))
def r8(spark, d):
    m = regress.unscaled(regress.fit_linear(*_inputs(spark, d), TWO, MLR))
    return m.select(
        "series_id", rounded(F.get("coef", F.lit(0)), 3).alias("scaled_1"), rounded(F.get("coef", F.lit(1)), 3).alias("scaled_2"),
        rounded(F.get("raw_coef", F.lit(0))).alias("raw_1"), rounded(F.get("raw_coef", F.lit(1))).alias("raw_2"),
        rounded(F.col("raw_intercept"), 2).alias("raw_intercept"))


_SCORE_SQL = sql("""
SELECT c.series_id, c.ds, c.kind, ROUND(b0 + b1 * x1 + b2 * x2, 2) AS yhat
FROM scoring c JOIN ols o ON c.series_id = o.series_id""", ROWS, STATS, OLS, FUTURE, SCORING)


@query("r1_mlr_forecast", _SCORE_SQL)
def r1_forecast(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), TWO, MLR).select(
        "series_id", "ds", "kind", rounded(F.col("yhat"), 2).alias("yhat"))


@query("r9_linear_scoring", _SCORE_SQL)
def r9(spark, d):
    product, drivers = _inputs(spark, d)
    models = regress.fit_linear(product, drivers, TWO, MLR)
    rows, names = regress.scoring_rows(product, drivers, TWO)
    return regress.score(models, rows, names).select("series_id", "ds", "kind", rounded(F.col("yhat"), 2).alias("yhat"))


@query("r1_mlr_four_drivers")
def r1_four(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), MONTHLY, MLR)


@query("r2_ols_statistics", sql("""
SELECT series_id, UNNEST(['n_orders', 'open_orders']) AS name, UNNEST([ROUND(b1, 4), ROUND(b2, 4)]) AS value,
       UNNEST([ROUND(sqrt(sigma2 * v2 / det), 4), ROUND(sqrt(sigma2 * v1 / det), 4)]) AS std_err,
       UNNEST([ROUND(b1 / sqrt(sigma2 * v2 / det), 4), ROUND(b2 / sqrt(sigma2 * v1 / det), 4)]) AS t_value,
       ROUND(1 - sse / (n * vy), 6) AS r2, n
FROM (SELECT *, n * (vy - b1 * c1y - b2 * c2y) AS sse, n * (vy - b1 * c1y - b2 * c2y) / (n - 3) AS sigma2,
             n * (v1 * v2 - c12 * c12) AS det FROM ols)""", ROWS, STATS, OLS))
def r2(spark, d):
    return regress.least_squares_stats(*_inputs(spark, d), TWO).where("name <> 'Intercept'").select(
        "series_id", "name", *[rounded(F.col(c)).alias(c) for c in ("value", "std_err", "t_value")],
        rounded(F.col("r2"), 6).alias("r2"), "n")


@query("r2_ols_p_values")
def r2_p(spark, d):
    return regress.least_squares_stats(*_inputs(spark, d), MONTHLY, scaled_coefficients=True)


@query("r10_driver_contribution", sql("""
SELECT c.series_id, c.ds, c.kind, UNNEST(['n_orders', 'open_orders', 'Intercept']) AS name,
       UNNEST([ROUND(b1 * x1, 2), ROUND(b2 * x2, 2), ROUND(b0, 2)]) AS value
FROM scoring c JOIN ols o ON c.series_id = o.series_id""", ROWS, STATS, OLS, FUTURE, SCORING))
def r10(spark, d):
    product, drivers = _inputs(spark, d)
    models = regress.fit_linear(product, drivers, TWO, MLR)
    rows, names = regress.scoring_rows(product, drivers, TWO)
    return regress.contributions(models, rows, names).select(
        "series_id", "ds", "kind", "name", rounded(F.col("value"), 2).alias("value"))


@query("j9_drivers_times_coefficients", sql("""
SELECT o.series_id, f.ds, UNNEST(['n_orders', 'open_orders']) AS driver,
       UNNEST([ROUND(b1 * x1, 2), ROUND(b2 * x2, 2)]) AS value
FROM ols o, future f""", ROWS, STATS, OLS, FUTURE))
def j9(spark, d):
    product, drivers = _inputs(spark, d)
    coef = regress.parameters(regress.fit_linear(product, drivers, TWO, MLR), TWO.drivers)
    future = calendars.horizon_rows(drivers.unpivot(["ds"], list(star.DRIVERS), "driver", "x"), TWO, "driver")
    return coef.join(future, F.col("name") == F.col("driver")).select(
        "series_id", "ds", "driver", rounded(F.col("value") * F.col("x"), 2).alias("value"))


ACCURACY = """
fc AS (
  SELECT *, yhat - y AS e, 100 * abs(yhat - y) / abs(y) AS ape FROM (
    SELECT o.series_id, f.ds, 'Multiple lineare Regression' AS method, p.y, b0 + b1 * x1 + b2 * x2 AS yhat
    FROM ols o CROSS JOIN future f LEFT JOIN product_monthly p ON p.series_id = o.series_id AND p.ds = f.ds
    WHERE o.series_id IN (
      SELECT series_id FROM product_monthly GROUP BY 1 HAVING date_diff('day', MIN(ds), MAX(ds)) >= 366
      AND COUNT(*) FILTER (WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01') = 54)))"""
_GUARDED = ", ".join(f"CASE WHEN COUNT(*) = COUNT(e) THEN {AGGREGATE_SQL[n]} END AS {n}" for n in ("mape", "mae", "total_bias"))


def usable_series(product, config):
    """Series that pass the spacing, history and completeness checks."""
    blocked = validate.blocked_series(calendars.aligned_calendar(product, config.granularity, config, "series_id", "y"))
    enough = validate.history_check(product, config.granularity).where("enough").select("series_id")
    return product.join(blocked, "series_id", "left_anti").join(enough, "series_id", "left_semi")


@query("r1_mlr_accuracy", sql(f"SELECT series_id, method, {_GUARDED} FROM fc GROUP BY 1, 2", ROWS, STATS, OLS, FUTURE, ACCURACY))
def r1_accuracy(spark, d):
    """Checked series, regression on two drivers, forecast, and its errors over the horizon."""
    product, drivers = _inputs(spark, d)
    product = usable_series(product, TWO)
    forecast = regress.forecast_linear(product, drivers, TWO, MLR).where("kind = 'pred'")
    joined = forecast.join(product, ["series_id", "ds"], "left")
    return metrics.score(joined, ("mape", "mae", "total_bias"))


# -- penalized --------------------------------------------------------------------------

RIDGE_SQL = """
folded AS (
  SELECT r.series_id, NTILE(5) OVER (PARTITION BY r.series_id ORDER BY r.ds) AS fold,
         (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y - my AS yc
  FROM rows2 r JOIN stats s ON r.series_id = s.series_id),
g AS (
  SELECT series_id, fold, COUNT(*) AS n, SUM(z1) AS s1, SUM(z2) AS s2, SUM(yc) AS sy, SUM(z1*z1) AS s11,
         SUM(z1*z2) AS s12, SUM(z2*z2) AS s22, SUM(z1*yc) AS s1y, SUM(z2*yc) AS s2y, SUM(yc*yc) AS syy
  FROM folded GROUP BY 1, 2),
t AS (
  SELECT series_id, SUM(n) AS n, SUM(s1) AS s1, SUM(s2) AS s2, SUM(sy) AS sy, SUM(s11) AS s11, SUM(s12) AS s12,
         SUM(s22) AS s22, SUM(s1y) AS s1y, SUM(s2y) AS s2y FROM g GROUP BY 1),
tr AS (
  SELECT g.*, t.n - g.n AS tn, (t.s1 - g.s1) / (t.n - g.n) AS t1, (t.s2 - g.s2) / (t.n - g.n) AS t2,
         (t.sy - g.sy) / (t.n - g.n) AS ty,
         t.s11 - g.s11 - (t.s1 - g.s1) ^ 2 / (t.n - g.n) AS a11, t.s22 - g.s22 - (t.s2 - g.s2) ^ 2 / (t.n - g.n) AS a22,
         t.s12 - g.s12 - (t.s1 - g.s1) * (t.s2 - g.s2) / (t.n - g.n) AS a12,
         t.s1y - g.s1y - (t.s1 - g.s1) * (t.sy - g.sy) / (t.n - g.n) AS c1,
         t.s2y - g.s2y - (t.s2 - g.s2) * (t.sy - g.sy) / (t.n - g.n) AS c2
  FROM g JOIN t ON g.series_id = t.series_id),
alphas AS (SELECT i, 0.5::DOUBLE * pow(10::DOUBLE, 10 - 12 * i / 7999::DOUBLE) AS alpha
           FROM (SELECT UNNEST(generate_series(0, 7999)) AS i)),
b AS (
  SELECT tr.*, i, alpha, (c1 * (a22 + alpha) - c2 * a12) / ((a11 + alpha) * (a22 + alpha) - a12 * a12) AS b1,
         (c2 * (a11 + alpha) - c1 * a12) / ((a11 + alpha) * (a22 + alpha) - a12 * a12) AS b2 FROM tr, alphas),
e AS (
  SELECT *, ty - b1 * t1 - b2 * t2 AS b0 FROM b),
scores AS (
  SELECT series_id, i, alpha, AVG(1 - (syy + n * b0 * b0 + b1 * b1 * s11 + b2 * b2 * s22 - 2 * b0 * sy - 2 * b1 * s1y
         - 2 * b2 * s2y + 2 * b0 * b1 * s1 + 2 * b0 * b2 * s2 + 2 * b1 * b2 * s12) / (syy - sy * sy / n)) AS score
  FROM e GROUP BY 1, 2, 3),
chosen AS (
  SELECT series_id, alpha, score FROM scores
  QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY score DESC, i) = 1),
ridge AS (
  SELECT o.series_id, alpha, score, n, my, m1, m2, s1, s2,
         (c1 * (n + alpha) - c2 * c) / ((n + alpha) ^ 2 - c * c) / s1 AS b1,
         (c2 * (n + alpha) - c1 * c) / ((n + alpha) ^ 2 - c * c) / s2 AS b2
  FROM (SELECT *, n * c12 / (s1 * s2) AS c, n * c1y / s1 AS c1, n * c2y / s2 AS c2 FROM stats) o
  JOIN chosen k ON o.series_id = k.series_id)"""


@query("r3_ridge", sql("""
SELECT series_id, ROUND(alpha, 3) AS alpha, ROUND(score, 6) AS cv_score, ROUND(b1, 4) + 0.0 AS b1, ROUND(b2, 4) + 0.0 AS b2,
       ROUND(my - b1 * m1 - b2 * m2, 2) AS intercept FROM ridge""", ROWS, STATS, RIDGE_SQL))
def r3(spark, d):
    m = regress.unscaled(regress.fit_linear(*_inputs(spark, d), TWO, RIDGE))
    return m.select("series_id", rounded(F.col("alpha"), 3).alias("alpha"), rounded(F.col("cv_score"), 6).alias("cv_score"),
                    rounded(F.get("raw_coef", F.lit(0))).alias("b1"), rounded(F.get("raw_coef", F.lit(1))).alias("b2"),
                    rounded(F.col("raw_intercept"), 2).alias("intercept"))


@query("r3_ridge_four_drivers")
def r3_four(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), MONTHLY, RIDGE)


@query("r3_ridge_walk_forward")
def r3_walk(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), replace(MONTHLY, walk_forward=True, cv_folds=3), RIDGE)


@query("r4_ridge_scenario", sql("""
SELECT r.series_id, f.ds, ROUND(my - b1 * m1 - b2 * m2 + b1 * x1 * CASE WHEN f.ds >= DATE '2001-01-01' THEN 1.1 ELSE 1 END + b2 * x2, 2) AS yhat
FROM ridge r, future f""", ROWS, STATS, FUTURE, RIDGE_SQL))
def r4(spark, d):
    """A fitted ridge model scored against edited future drivers."""
    product, drivers = _inputs(spark, d)
    models = regress.fit_linear(product, drivers, TWO, RIDGE)
    long = drivers.unpivot(["ds"], list(star.DRIVERS), "driver", "x")
    future = calendars.horizon_rows(long, TWO, "driver").drop("step")
    edits = future.where((F.col("driver") == "n_orders") & (F.col("ds") >= "2001-01-01")).withColumn("x", F.col("x") * 1.1)
    edited = assemble.with_overrides(future, edits)
    wide = edited.groupBy("ds").pivot("driver", list(star.DRIVERS)).agg(F.first("x"))
    rows, names = regress.scoring_rows(product, wide, TWO)
    return regress.score(models, rows.where("kind = 'pred'"), names).select(
        "series_id", "ds", rounded(F.col("yhat"), 2).alias("yhat"))


@query("j5_coefficient_report", sql("""
SELECT o.series_id, UNNEST(['n_orders', 'open_orders', 'Intercept', 'Regularization Strength Alpha']) AS name,
       UNNEST([ROUND(o.b1, 3), ROUND(o.b2, 3), ROUND(o.b0, 1), NULL]) AS "Multiple lineare Regression",
       UNNEST([ROUND(r.b1, 3) + 0.0, ROUND(r.b2, 3) + 0.0, ROUND(r.my - r.b1 * r.m1 - r.b2 * r.m2, 1), ROUND(r.alpha, 3)]) AS "Ridge"
FROM ols o JOIN ridge r ON o.series_id = r.series_id""", ROWS, STATS, OLS, RIDGE_SQL))
def j5(spark, d):
    inputs = _inputs(spark, d)
    params = regress.parameters(regress.fit_linear(*inputs, TWO, MLR), TWO.drivers).unionByName(
        regress.parameters(regress.fit_linear(*inputs, TWO, RIDGE), TWO.drivers))
    wide = assemble.coefficients_wide(params, (MLR, RIDGE))
    def shown(c):
        return F.when(F.col("name") == "Intercept", rounded(F.col(f"`{c}`"), 1)).otherwise(rounded(F.col(f"`{c}`"), 3)).alias(c)
    return wide.select("series_id", "name", shown(MLR), shown(RIDGE))


def _penalized_sql(ratios: tuple[float, ...]) -> str:
    """Two drivers: the minimum of the objective over all sign patterns, for every penalty."""
    points = ", ".join(f"""{{'b1': (({p}) * (q22 + l2) - ({q}) * q12) / det, 'b2': (({q}) * (q11 + l2) - ({p}) * q12) / det}}"""
                       for p in ("q1 - l1", "q1 + l1") for q in ("q2 - l1", "q2 + l1"))
    def best(source: str) -> str:
        return f"""
  SELECT *, list_min(list_transform([{{'b1': 0.0::DOUBLE, 'b2': 0.0::DOUBLE}},
      {{'b1': sign(q1) * greatest(abs(q1) - l1, 0) / (q11 + l2), 'b2': 0.0::DOUBLE}},
      {{'b1': 0.0::DOUBLE, 'b2': sign(q2) * greatest(abs(q2) - l1, 0) / (q22 + l2)}}, {points}],
    lambda p: {{'o': (q11 + l2) * p.b1 * p.b1 / 2 + (q22 + l2) * p.b2 * p.b2 / 2 + q12 * p.b1 * p.b2 - q1 * p.b1 - q2 * p.b2
                     + l1 * (abs(p.b1) + abs(p.b2)), 'b1': p.b1, 'b2': p.b2}})) AS best
  FROM (SELECT *, (q11 + l2) * (q22 + l2) - q12 * q12 AS det FROM {source})"""
    listed = ", ".join(str(r) for r in ratios)
    return RIDGE_SQL.split("alphas AS")[0] + f"""
pen AS (SELECT i, r, alpha, ratio, alpha * ratio AS l1, alpha * (1 - ratio) AS l2 FROM (
  SELECT i, 0.5::DOUBLE * pow(10::DOUBLE, 10 - 12 * i / 4999::DOUBLE) AS alpha FROM (SELECT UNNEST(generate_series(0, 4999)) AS i)),
  (SELECT UNNEST([{listed}]::DOUBLE[]) AS ratio, UNNEST(generate_series(1, {len(ratios)})) AS r)),
paths AS ({best("(SELECT tr.*, pen.*, a11 / tn AS q11, a22 / tn AS q22, a12 / tn AS q12, c1 / tn AS q1, c2 / tn AS q2 FROM tr, pen)")}),
errors AS (
  SELECT series_id, i, r, alpha, ratio, list_sum(list((syy + n * b0 * b0 + b1 * b1 * s11 + b2 * b2 * s22 - 2 * b0 * sy - 2 * b1 * s1y - 2 * b2 * s2y
         + 2 * b0 * b1 * s1 + 2 * b0 * b2 * s2 + 2 * b1 * b2 * s12) / n ORDER BY fold)) / 5 AS mse
  FROM (SELECT *, best.b1 AS b1, best.b2 AS b2, ty - best.b1 * t1 - best.b2 * t2 AS b0 FROM paths) GROUP BY ALL),
chosen AS (SELECT * FROM errors QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY mse, r, i) = 1),
final AS ({best("""(SELECT k.series_id, k.alpha, k.ratio, k.mse, alpha * ratio AS l1, alpha * (1 - ratio) AS l2, my, m1, m2, s1 AS sd1, s2 AS sd2,
    1.0::DOUBLE AS q11, 1.0::DOUBLE AS q22, c12 / (s1 * s2) AS q12, c1y / s1 AS q1, c2y / s2 AS q2
    FROM chosen k JOIN stats o ON k.series_id = o.series_id)""")})"""


_PENALIZED_SELECT = """
SELECT series_id, ROUND(alpha, 3) AS alpha, ROUND(ratio, 2) AS l1_ratio, ROUND(sqrt(mse), 3) AS cv_rmse, ROUND(best.b1 / sd1, 4) + 0.0 AS b1,
       ROUND(best.b2 / sd2, 4) + 0.0 AS b2, ROUND((my - best.b1 / sd1 * m1 - best.b2 / sd2 * m2) / my, 8) AS intercept_share FROM final"""


def _penalized(spark, d, method):
    m = regress.unscaled(regress.fit_linear(*_inputs(spark, d), TWO, method))
    return m.select(
        "series_id", rounded(F.col("alpha"), 3).alias("alpha"), F.coalesce("l1_ratio", F.lit(1.0)).alias("l1_ratio"),
        rounded(F.sqrt("cv_score"), 3).alias("cv_rmse"), rounded(F.get("raw_coef", F.lit(0))).alias("b1"),
        rounded(F.get("raw_coef", F.lit(1))).alias("b2"), rounded(F.col("raw_intercept") / F.col("y_mean"), 8).alias("intercept_share"))


@query("r5_lasso", sql(_PENALIZED_SELECT, ROWS, STATS, _penalized_sql((1.0,))))
def r5(spark, d):
    return _penalized(spark, d, LASSO)


@query("r6_elastic_net", sql(_PENALIZED_SELECT, ROWS, STATS, _penalized_sql(regress.L1_RATIOS)))
def r6(spark, d):
    return _penalized(spark, d, ELASTIC_NET)


@query("r5_lasso_four_drivers")
def r5_four(spark, d):
    return regress.parameters(regress.fit_linear(*_inputs(spark, d), MONTHLY, LASSO), MONTHLY.drivers)


@query("r5_lasso_forecast")
def r5_forecast(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), MONTHLY, LASSO)


@query("r6_elastic_net_four_drivers")
def r6_four(spark, d):
    return regress.parameters(regress.fit_linear(*_inputs(spark, d), MONTHLY, ELASTIC_NET), MONTHLY.drivers)


@query("r6_elastic_net_forecast")
def r6_forecast(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), MONTHLY, ELASTIC_NET)


@query("r6_elastic_net_lagged")
def r6_lagged(spark, d):
    return regress.forecast_linear(*_inputs(spark, d), replace(TWO, lags=(1, 2)), ELASTIC_NET)

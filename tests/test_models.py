"""Smoothing, decomposition, ARIMA and the regressions on generated series."""

from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from fleetcast.config import ELASTIC_NET, LASSO, MLR, RIDGE, SARIMA, SARIMAX, ForecastConfig
from fleetcast.operators import arima, explore, regress, smooth, stl

MONTHS = [d.date() for d in pd.date_range("2010-01-01", periods=96, freq="MS")]
CONFIG = ForecastConfig(date(2010, 1, 1), date(2017, 1, 1), 12, "month", 12, drivers=("a", "b", "c"))
N_TRAIN = 84


def table(spark, series: dict):
    rows = [(k, d, float(v)) for k, values in series.items() for d, v in zip(MONTHS, values)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(96, 3)) * [1, 100, 0.01] + [0, 500, 3]
    series = {f"s{i}": 10 + 2 * x[:, 0] - 0.01 * x[:, 1] + 30 * x[:, 2] + rng.normal(size=96) * 0.3 for i in range(6)}
    drivers = spark.createDataFrame([(d, *map(float, r)) for d, r in zip(MONTHS, x)], "ds date, a double, b double, c double")
    return table(spark, series), drivers, x, series


# -- regressions ------------------------------------------------------------------------

def test_least_squares_recovers_rows_solution(linear):
    product, drivers, x, series = linear
    got = {(r.series_id, r.name): r.value for r in regress.parameters(regress.fit_linear(product, drivers, CONFIG, MLR), CONFIG.drivers).collect()}
    for s, y in series.items():
        want, *_ = np.linalg.lstsq(np.column_stack([np.ones(N_TRAIN), x[:N_TRAIN]]), y[:N_TRAIN], rcond=None)
        assert np.allclose([got[s, n] for n in ("Intercept", "a", "b", "c")], want, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("method", [MLR, RIDGE, LASSO, ELASTIC_NET])
def test_forecast_is_complete_and_close(linear, method):
    product, drivers, _, _ = linear
    got = regress.forecast_linear(product, drivers, CONFIG, method).join(product, ["series_id", "ds"]).toPandas()
    assert not got.isna().any().any()
    pred = got[got.kind == "pred"]
    assert (pred.groupby("series_id").size() == 12).all() and (got[got.kind == "fit"].groupby("series_id").size() == N_TRAIN).all()
    assert (pred.yhat - pred.y).abs().mean() < 0.6


def test_contributions_add_up_to_the_forecast(linear):
    product, drivers, _, _ = linear
    models = regress.fit_linear(product, drivers, CONFIG, RIDGE)
    rows, names = regress.scoring_rows(product, drivers, CONFIG)
    parts = regress.contributions(models, rows, names).groupBy("series_id", "ds").agg(F.sum("value").alias("total"))
    both = parts.join(regress.score(models, rows, names), ["series_id", "ds"]).toPandas()
    assert np.allclose(both.total, both.yhat)


@pytest.mark.parametrize("method", [RIDGE, LASSO, ELASTIC_NET])
def test_agrees_with_the_global_solver(spark, linear, method):
    """Spark's own penalized regression on one series, with penalties mapped to its scale."""
    product, drivers, _, series = linear
    one = product.where("series_id = 's0'")
    m = regress.unscaled(regress.fit_linear(one, drivers, CONFIG, method)).first()
    n, sigma = N_TRAIN, float(np.std(series["s0"][:N_TRAIN]))
    if method == RIDGE:
        reg, mix = m.alpha / n * sigma, 0.0
    else:
        r = 1.0 if method == LASSO else m.l1_ratio
        reg = m.alpha * (r + (1 - r) * sigma)
        mix = r / (r + (1 - r) * sigma)
    train = one.where(F.col("ds") < "2017-01-01").join(drivers, "ds")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(train)
    lr = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=mix, standardization=True, solver="normal", maxIter=1000, tol=1e-12).fit(data)
    assert np.allclose(m.raw_coef, lr.coefficients.toArray(), rtol=1e-3, atol=1e-5)
    assert m.raw_intercept == pytest.approx(lr.intercept, rel=1e-3)


def test_statistics_equal_textbook_formulas(linear):
    product, drivers, x, series = linear
    got = regress.least_squares_stats(product, drivers, CONFIG).where("series_id = 's1'").toPandas().set_index("name")
    design = np.column_stack([np.ones(N_TRAIN), x[:N_TRAIN]])
    y = series["s1"][:N_TRAIN]
    b = np.linalg.solve(design.T @ design, design.T @ y)
    res = y - design @ b
    err = np.sqrt(res @ res / (N_TRAIN - 4) * np.diag(np.linalg.inv(design.T @ design)))
    order = ["Intercept", "a", "b", "c"]
    assert np.allclose(got.loc[order, "std_err"], err, rtol=1e-6)
    assert np.allclose(got.loc[order, "t_value"], b / err, rtol=1e-6)
    assert got.r2.iloc[0] == pytest.approx(1 - res @ res / ((y - y.mean()) ** 2).sum())


def test_lags_extend_both_windows(linear):
    product, drivers, _, _ = linear
    got = regress.forecast_linear(product, drivers, replace(CONFIG, lags=(1,)), MLR).toPandas()
    counts = got.groupby(["series_id", "kind"]).size().unstack()
    # The first month has no lagged value; the horizon is complete.
    assert (counts["fit"] == N_TRAIN - 1).all() and (counts["pred"] == 12).all()


def test_walk_forward_validation_runs(linear):
    product, drivers, _, _ = linear
    models = regress.fit_linear(product, drivers, replace(CONFIG, walk_forward=True, cv_folds=3), RIDGE).collect()
    assert len(models) == 6 and all(m.cv_score > 0.5 for m in models)


# -- decomposition ----------------------------------------------------------------------

def seasonal_series():
    t = np.arange(96)
    season = 10 * np.sin(2 * np.pi * t / 12)
    rng = np.random.default_rng(1)
    return {"add": 100 + 0.5 * t + season + rng.normal(size=96), "mul": (100 + t) * (1 + 0.2 * np.sin(2 * np.pi * t / 12)) + rng.normal(size=96),
            "neg": -50 + 0.1 * t + season + rng.normal(size=96)}


def test_parts_sum_to_the_series(spark):
    for parts in (explore.decompose(table(spark, seasonal_series()), 12).dropna(), stl.decompose(table(spark, seasonal_series()), 12)):
        p = parts.toPandas()
        assert np.allclose(p.trend + p.seasonal + p.rest, p.y)


def test_local_regression_recovers_trend_and_season(spark):
    t = np.arange(96)
    clean = {"s": 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)}
    p = stl.decompose(table(spark, clean), 12).orderBy("ds").toPandas()
    assert np.abs(p.trend - (100 + 0.5 * t)).max() < 0.3
    assert np.abs(p.seasonal - 10 * np.sin(2 * np.pi * t / 12)).max() < 0.3


def test_outlier_is_flagged(spark):
    s = seasonal_series()["add"].copy()
    s[50] += 40
    z = explore.outliers(explore.decompose(table(spark, {"s": s}), 12)).where("outlier").collect()
    assert [r.ds for r in z] == [MONTHS[50]]


# -- smoothing --------------------------------------------------------------------------

def test_grid_has_thirty_effective_configurations():
    grid = smooth.configurations()
    assert len(grid) == 30 and len({(c["trend"], c["damped"], c["season"], c["box_cox"]) for c in grid}) == 30


def test_smoothing_forecast_is_complete_and_close(spark):
    product = table(spark, seasonal_series())
    out, params = smooth.holt_winters(product, CONFIG)
    got = out.join(product, ["series_id", "ds"]).toPandas()
    pred = got[got.kind == "pred"]
    assert (pred.groupby("series_id").size() == 12).all() and not got.isna().any().any()
    assert ((pred.yhat - pred.y).abs().groupby(pred.series_id).mean() < 6).all()
    names = {r.name for r in params.collect()}
    assert {"smoothing level alpha", "AIC", "Trend", "boxcox"} <= names


def test_negative_series_has_only_additive_configurations(spark):
    packed = smooth.packed_series(table(spark, seasonal_series()), CONFIG)
    ids = {r.config_id for r in smooth.fit_configurations(packed, CONFIG, 0).where("series_id = 'neg'").collect()}
    grid = smooth.configurations()
    assert ids == {c["config_id"] for c in grid if not c["box_cox"] and "mul" not in (c["trend"], c["season"])}


def test_zoom_never_worsens_the_fit(spark):
    packed = smooth.packed_series(table(spark, {"add": seasonal_series()["add"]}), CONFIG)
    key = ["series_id", "config_id"]
    rough = smooth.fit_configurations(packed, CONFIG, 0).where("NOT isnan(sse)").select(*key, F.col("sse").alias("rough"), F.col("lam").alias("l"))
    both = smooth.fit_configurations(packed, CONFIG, 3).join(rough, key).where("l IS NULL").collect()
    assert both and all(r.sse <= r.rough * (1 + 1e-12) for r in both)


def test_fold_equals_vectorized_recursion(spark):
    packed = smooth.packed_series(table(spark, {"add": seasonal_series()["add"]}), CONFIG)
    fold = smooth.smooth_additive(packed, 12, 0.4, 0.1, 0.3, 0.9).first()
    config = next(c for c in smooth.configurations() if c["trend"] == "add" and c["damped"] and c["season"] == "add" and not c["box_cox"])
    y = np.array(packed.first().y)[None, :]
    res = smooth.run(y, None, config, 12, np.array([[[0.4, 0.1, 0.3, 0.9]]]), keep=True)
    assert fold.sse == pytest.approx(res["sse"][0, 0])
    assert np.allclose(fold.seasonal, res["season"][0]) and np.allclose(fold.fit, res["fit"][0])


def test_short_series_keeps_simple_configurations(spark):
    config = replace(CONFIG, train_start=date(2015, 6, 1))
    packed = smooth.packed_series(table(spark, {"add": seasonal_series()["add"]}), config)
    grid = smooth.configurations()
    ids = {r.config_id for r in smooth.fit_configurations(packed, config, 0).collect()}
    assert ids == {c["config_id"] for c in grid if c["trend"] is None and c["season"] is None}


# -- ARIMA ------------------------------------------------------------------------------

def arma_series(n=300):
    rng = np.random.default_rng(11)
    e = rng.normal(size=n + 50)
    ar, ma = np.zeros(n + 50), np.zeros(n + 50)
    for t in range(1, n + 50):
        ar[t] = 0.7 * ar[t - 1] + e[t]
        ma[t] = e[t] + 0.6 * e[t - 1]
    walk = np.cumsum(e)
    return {"ar": ar[50:] + 20, "ma": ma[50:] + 20, "walk": walk[50:]}


DAYS = [d.date() for d in pd.date_range("2020-01-01", periods=300, freq="D")]
DAY_CONFIG = ForecastConfig(DAYS[0], DAYS[280], 10, "day", 7, drivers=("a", "b"))


@pytest.fixture(scope="module")
def arma(spark):
    rows = [(k, d, float(v)) for k, s in arma_series().items() for d, v in zip(DAYS, s)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def test_differencing_orders(arma):
    got = {r.series_id: r for r in arima.differencing_orders(arma, DAY_CONFIG, 3).collect()}
    assert got["ar"].d_adf == 0 and got["ma"].d_pp == 0 and got["walk"].d_adf == 1 and got["walk"].d_pp == 1
    assert all(r.seasonal_d == 0 for r in got.values())


def test_strong_season_is_reported(spark):
    """A season that repeats itself exactly has full strength, but is stable: the test by Canova and Hansen asks for no difference."""
    got = arima.differencing_orders(table(spark, seasonal_series()), CONFIG, 3).collect()
    assert got and all(r.strength > 0.9 for r in got)


def _coefficients(frame, series, used):
    """Stage two of one candidate solved from its rows."""
    rows = frame.where((F.col("kind") == "fit") & (F.col("series_id") == series)).orderBy("ds").toPandas()
    x = np.stack(rows.features.to_numpy())[:, used]
    b, *_ = np.linalg.lstsq(x, rows.w.to_numpy(), rcond=None)
    return b, ((rows.w.to_numpy() - x @ b) ** 2).sum(), rows


def test_candidates_equal_row_regressions(arma):
    frame = arima.regression_frame(arma, None, DAY_CONFIG, SARIMA)
    n_features = len(arima.feature_names((), 7))
    got = arima.candidates(arima.frame_moments(frame, n_features), 7, 0)
    r = got.where("series_id = 'ar' AND p = 1 AND q = 0 AND sp = 0 AND sq = 0 AND trend = 'None'").first()
    b, sse, _ = _coefficients(frame, "ar", [2])
    assert r.sse == pytest.approx(sse, rel=1e-6) and b[0] == pytest.approx(0.7, abs=0.1)
    r = got.where("series_id = 'ma' AND p = 0 AND q = 1 AND sp = 0 AND sq = 0 AND trend = 'c'").first()
    b, sse, rows = _coefficients(frame, "ma", [0, 8])
    assert r.sse == pytest.approx(sse, rel=1e-6) and b[1] == pytest.approx(0.6, abs=0.12)
    assert r.aic == pytest.approx(len(rows) * np.log(sse / len(rows)) + 2 * r.k, rel=1e-6)


def test_long_autoregression_solves_the_normal_equations(spark):
    gamma = [10.0, 6.0, 3.0, 2.0]
    got = spark.createDataFrame([(gamma,)], "g array<double>").select(arima.levinson(F.col("g"))).first()[0]
    toeplitz = np.array([[gamma[abs(i - j)] for j in range(3)] for i in range(3)])
    assert np.allclose(got, np.linalg.solve(toeplitz, gamma[1:]))


@pytest.mark.parametrize("criterion", arima.CRITERIA)
def test_search_picks_the_least_criterion(arma, criterion):
    packed = arima.frame_moments(arima.regression_frame(arma, None, DAY_CONFIG, SARIMA), len(arima.feature_names((), 7)))
    best = {r.series_id: r.criterion for r in arima.search(packed, 7, 0, criterion).collect()}
    least = {r.series_id: r.v for r in arima.candidates(packed, 7, 0).groupBy("series_id").agg(F.min(criterion).alias("v")).collect()}
    assert best.keys() == least.keys() and all(best[s] == pytest.approx(least[s], rel=1e-6) for s in best)


def test_random_walk_forecast_stays_near_the_last_value(arma):
    out, params = arima.arima(arma, None, replace(DAY_CONFIG, criterion="bic"))
    got = out.toPandas()
    assert not got.isna().any().any() and (got[got.kind == "pred"].groupby("series_id").size() == 10).all()
    walk = got[(got.series_id == "walk") & (got.kind == "pred")].yhat
    last = arma_series()["walk"][279]
    assert np.abs(walk - last).max() < 4
    assert {"Order", "Seasonal Order", "Trend", "AIC", "BIC"} <= {r.name for r in params.collect()}


def test_drivers_and_subsets(spark, linear):
    product, drivers, _, _ = linear
    out, _ = arima.arima(product, drivers, CONFIG)
    got = out.where("kind = 'pred'").join(product, ["series_id", "ds"]).toPandas()
    assert len(got) == 72 and (got.yhat - got.y).abs().mean() < 1.0
    frame = arima.regression_frame(product, drivers, CONFIG, SARIMAX)
    packed = arima.frame_moments(frame, len(arima.feature_names(CONFIG.drivers, 12)))
    full = {r.series_id: r.criterion for r in arima.search(packed, 12, 3).collect()}
    some = arima.search(packed, 12, 3, subsets=True).collect()
    assert all(r.criterion <= full[r.series_id] + 1e-9 for r in some) and all(r.driver_mask & 1 for r in some)


def test_multi_step_undo_of_differences():
    y = np.random.default_rng(0).normal(size=60).cumsum()
    weights = arima.difference_weights(2, 1, 12)
    w = sum(c * y[60 - 20 - j:60 - j] for j, c in weights.items())
    z = np.diff(np.diff(y[12:] - y[:-12]))
    assert np.allclose(w, z[-20:])


"""Differencing statistics and seasonal products against row-level computations."""

import math
from datetime import date
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetcast.config import SARIMA, SARIMAX, ForecastConfig
from fleetcast.operators import arima, explore, roots

MONTHS = [d.date() for d in pd.date_range("2010-01-01", periods=108, freq="MS")]
CONFIG = ForecastConfig(MONTHS[0], MONTHS[96], 12, "month", 12, drivers=("a", "b"))


def made_series() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    t = np.arange(108)
    shocks = rng.normal(size=108)
    turning = np.zeros(108)
    for i in range(108):
        turning[i] = (turning[i - 12] if i >= 12 else 10 * np.sin(i)) + 3 * rng.normal()
    return {"season": 50 + 10 * np.sin(2 * np.pi * t / 12) + shocks, "turning": 200 + turning, "walk": 100 + np.cumsum(shocks),
            "twice": np.cumsum(np.cumsum(shocks)), "noise": 5 + shocks, "flat": np.full(108, 7.0)}


@pytest.fixture(scope="module")
def monthly(spark):
    rows = [(k, d, float(v)) for k, s in made_series().items() for d, v in zip(MONTHS, s)]
    rows += [("gap", d, 1.0) for d in MONTHS if d.month != 5] + [("short", d, float(i)) for i, d in enumerate(MONTHS[90:96])]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def adf_by_rows(y):
    k = int(round((len(y) - 1) ** (1 / 3), 9)) + 1
    dy = np.diff(y)
    x = np.column_stack([y[k - 1:-1], np.ones(len(dy) - k + 1), np.arange(k, len(dy) + 1), *[dy[k - 1 - j:len(dy) - j] for j in range(1, k)]])
    b, *_ = np.linalg.lstsq(x, dy[k - 1:], rcond=None)
    u = dy[k - 1:] - x @ b
    return b[0] / math.sqrt(u @ u / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])


def pp_by_rows(y):
    now, before = y[1:], y[:-1]
    n = len(now)
    t = np.arange(1, n + 1)
    x = np.column_stack([np.ones(n), t, before])
    b, *_ = np.linalg.lstsq(x, now, rcond=None)
    u = now - x @ b
    width = int(4 * (n / 100) ** 0.25)
    extra = 2 / n * sum((1 - j / (width + 1)) * (u[j:] @ u[:-j]) for j in range(1, width + 1))
    s, st = before.sum(), before @ t
    spread = n * n * (n * n - 1) * (before @ before) / 12 - n * st ** 2 + n * (n + 1) * st * s - n * (n + 1) * (2 * n + 1) * s ** 2 / 6
    return n * (b[2] - 1) - n ** 6 / (24 * spread) * extra


def ch_by_rows(y, m):
    n, width = len(y), int(round(m * (len(y) / 100) ** 0.25))
    waves = np.array([roots.harmonics(m)[t % m] for t in range(n)])
    x = np.column_stack([np.ones(n), waves])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    f = waves * (y - x @ b)[:, None]
    cover = f.T @ f + sum((1 - k / (width + 1)) * (f[k:].T @ f[:-k] + f[:-k].T @ f[k:]) for k in range(1, width + 1))
    sums = np.cumsum(f, 0)
    return np.trace(np.linalg.solve(cover / n, sums.T @ sums)) / n ** 2


def test_unit_root_statistics(monthly):
    rows, longest = arima.complete_rows(monthly, CONFIG)
    got = {(r.series_id, r.level): r for r in roots.unit_roots(rows, 3, longest).collect()}
    for name, y in made_series().items():
        y = y[:96]
        for level in range(3):
            r = got[name, level]
            if name == "flat":
                assert r.adf is None and r.pp is None
            else:
                assert r.adf == pytest.approx(adf_by_rows(y), rel=1e-5) and r.pp == pytest.approx(pp_by_rows(y), rel=1e-5)
            y = np.diff(y)
    assert ("gap", 0) not in got and got["short", 0].adf is None


def test_seasonal_statistics(monthly):
    rows, longest = arima.complete_rows(monthly, CONFIG)
    got = {(r.series_id, r.level): r.statistic for r in roots.seasonal_stability(rows, 12, 3, longest).collect()}
    for name, y in made_series().items():
        y = y[:96]
        for level in range(3):
            assert got[name, level] is None if name == "flat" else got[name, level] == pytest.approx(ch_by_rows(y, 12), rel=1e-6)
            y = y[12:] - y[:-12]


@pytest.mark.parametrize("m", [4, 7, 12])
def test_harmonics_span_the_season(m):
    waves = np.column_stack([np.ones(m), roots.harmonics(m)])
    assert np.linalg.matrix_rank(waves) == m and roots.ch_critical(m) > 0.4
    assert roots.ch_critical(24) == 5.098624 and roots.ch_critical(20) == pytest.approx(0.269 * 20 ** 0.928)


def test_orders(monthly):
    got = {r.series_id: r for r in arima.differencing_orders(monthly, CONFIG, 3).collect()}
    assert set(got) == {*made_series(), "short"}
    # a season that repeats itself is stable and needs no difference
    assert got["season"].seasonal_d == 0 and got["season"].strength > 0.9
    assert (got["noise"].d_adf, got["walk"].d_adf, got["twice"].d_adf) == (0, 1, 2) and got["flat"].d_pp == 0 and got["short"].seasonal_d == 0


def test_wandering_season_is_differenced(spark):
    """Quarters, since eight years are too short for the test to reject twelve seasons."""
    rng, y = np.random.default_rng(0), np.zeros(108)
    for i in range(108):
        y[i] = (y[i - 4] if i >= 4 else 0) + rng.normal()
    rows, longest = arima.complete_rows(spark.createDataFrame([("w", d, float(v)) for d, v in zip(MONTHS, y)], "series_id string, ds date, y double"), CONFIG)
    got = roots.seasonal_orders(rows, 4, 3, longest).first()
    assert got.ch == pytest.approx(ch_by_rows(y[:96], 4)) and got.ch > roots.ch_critical(4) and got.seasonal_d == 1
    assert ch_by_rows(y[4:96] - y[:92], 4) < roots.ch_critical(4)


def test_product_of_lag_polynomials(spark):
    """Factors found by Gauss-Newton steps are where a fine grid has its least error."""
    rng = np.random.default_rng(8)
    e, y = rng.normal(size=1300), np.zeros(1300)
    for t in range(13, 1300):
        y[t] = 0.5 * y[t - 1] + 0.4 * y[t - 12] - 0.2 * y[t - 13] + e[t]
    days = [d.date() for d in pd.date_range("2015-01-01", periods=1200, freq="D")]
    config = ForecastConfig(days[0], days[1190], 5, "day", 12, drivers=("a", "b"))
    product = spark.createDataFrame([("p", d, float(v)) for d, v in zip(days, y[100:])], "series_id string, ds date, y double")
    r = arima.given_order(product, config, 0, 0, (1, 0, 1, 0)).first()
    names = arima.parameter_names((), 12)
    phi, seasonal = r.params[names.index("ar.L1")], r.params[names.index("ar.S.L12")]
    w = y[100:1290] - y[100:1290].mean()
    lag = lambda k: np.r_[np.zeros(k), w[:-k]]
    error = lambda a, b: ((w - a * lag(1) - b * lag(12) + a * b * lag(13)) ** 2).sum()
    assert r.sse == pytest.approx(error(phi, seasonal), rel=1e-8) and phi == pytest.approx(0.5, abs=0.08) and seasonal == pytest.approx(0.4, abs=0.08)
    around = [error(phi + a, seasonal + b) for a in (-1e-3, 0, 1e-3) for b in (-1e-3, 0, 1e-3)]
    assert min(around) == pytest.approx(around[4]) and r.n == 1190


def test_steps_never_lose():
    """All candidates: products are no worse than no lags at all, and equal to plain least squares where nothing is multiplied."""
    rng = np.random.default_rng(4)
    factors = arima.Factors(12, 1)
    x = rng.normal(size=(80, factors.n_features))
    z = np.column_stack([x, x @ rng.normal(size=factors.n_features) * 0.2 + rng.normal(size=80)])
    mom = z.T @ z
    info, masks = arima.candidate_masks(12, 1, True)
    params = arima.product_fit(mom, masks, factors)
    error = lambda p: ((z[:, -1] - x @ factors.weights(p[None])[0]) ** 2).sum()
    for i in range(0, len(masks), 37):
        assert not params[i][masks[i] == 0].any() and error(params[i]) <= z[:, -1] @ z[:, -1] * (1 + 1e-9)
        used = masks[i] > 0
        if not ((info.p[i] and info.sp[i]) or (info.q[i] and info.sq[i])):
            b, *_ = np.linalg.lstsq(x[:, :factors.n][:, used], z[:, -1], rcond=None)
            assert np.allclose(params[i][used], b, atol=1e-5)


def test_one_fit_per_training_row(monthly):
    usable = monthly.where("series_id NOT IN ('flat', 'short', 'gap')")
    out, _ = arima.arima(usable, None, CONFIG)
    got = out.toPandas()
    counts = got.groupby(["series_id", "kind"]).size().unstack()
    assert (counts.fit == 96).all() and (counts.pred == 12).all() and not got.yhat.isna().any()
    walk = got[(got.series_id == "walk") & (got.kind == "fit")].sort_values("ds").yhat.to_numpy()
    y = made_series()["walk"]
    assert walk[0] == 0.0 and np.abs(walk[1:] - y[1:96]).mean() < 1.5  # nothing is known before the first value of a differenced series


def test_start_uses_only_the_past():
    y = np.arange(1.0, 16.0) ** 2
    fit = arima.start_fit(y, 1, 1, 12)
    assert fit[0] == 0 and fit[1:12] == list(y[:11]) and fit[12] == y[0] and fit[13] == y[1] + y[12] - y[0]


def test_contributions_add_up(spark, monthly):
    rng = np.random.default_rng(6)
    a, b = np.cumsum(rng.normal(size=108)), rng.normal(size=108)
    drivers = spark.createDataFrame([(d, float(x), float(z)) for d, x, z in zip(MONTHS, a, b)], "ds date, a double, b double")
    ys = {"plain": 20 + 3 * a + rng.normal(size=108) * 0.1, "summed": np.cumsum(2 * b + rng.normal(size=108) * 0.1) + 50}
    product = spark.createDataFrame([(k, d, float(v)) for k, s in ys.items() for d, v in zip(MONTHS, s)], "series_id string, ds date, y double")
    frame = arima.regression_frame(product, drivers, CONFIG, SARIMAX)
    models = arima.search(arima.frame_moments(frame, len(arima.feature_names(("a", "b"), 12))), 12, 2).cache()
    parts = arima.contributions(frame, models, CONFIG, ("a", "b"))
    sums = parts.groupBy("series_id", "ds", "kind").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    both = sums.join(arima.forecast(frame, models, CONFIG, SARIMAX, 2), ["series_id", "ds", "kind"]).toPandas()
    assert len(both) == 2 * 108 and (both.n == 3).all() and (both.total - both.yhat).abs().max() < 1e-6
    pred = parts.where("kind = 'pred'").groupBy("series_id", "name").agg(F.stddev("value").alias("sd")).toPandas().set_index(["series_id", "name"]).sd
    assert pred["plain", "a"] > pred["plain", "b"] and pred["summed", "b"] > pred["summed", "a"]


def test_paths_are_linear():
    """The path of a sum of inputs and pasts is the sum of their paths."""
    rng = np.random.default_rng(2)
    lags, weights = [1, 2, 12], arima.difference_weights(1, 1, 12)
    w, e, y, x1, x2 = rng.normal(size=30), rng.normal(size=30), rng.normal(size=43), rng.normal(size=8), rng.normal(size=8)
    phi, theta, none = np.array([0.4, 0.1, 0.2]), np.array([0.3, 0.0, 0.1]), np.zeros(0)
    whole = arima.ahead(w, e, y, x1 + x2, phi, theta, lags, weights, 0.7)
    parts = [arima.ahead(none, none, none, x1, phi, theta, lags, weights), arima.ahead(none, none, none, x2, phi, theta, lags, weights),
             arima.ahead(w, e, y, np.zeros(8), phi, theta, lags, weights, 0.7)]
    assert np.allclose(whole, sum(parts))


@pytest.mark.parametrize("criterion", ["aic", "bic"])
def test_best_subset_equals_full_enumeration(spark, criterion):
    rng = np.random.default_rng(7)
    names = ("a", "b", "c", "d")
    packed, want = [], {}
    for s in range(20):
        x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
        y = x @ (rng.normal(size=4) * (rng.random(4) < 0.5)) + rng.normal(size=40)
        z = np.column_stack([np.ones(40), x, y])
        m = z.T @ z
        packed.append((f"s{s}", [float(v) for v in m[np.triu_indices(6)]]))
        found = []
        for size in range(5):
            for chosen in combinations(range(4), size):
                d = np.column_stack([np.ones(40), x[:, chosen]])
                sse = ((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum()
                found.append((40 * math.log(sse / 40) + (2 if criterion == "aic" else math.log(40)) * (size + 2), sum(1 << i for i in chosen)))
        want[f"s{s}"] = min(found)
    got = arima.best_driver_subset(spark.createDataFrame(packed, "series_id string, moments array<double>"), names, criterion).collect()
    assert {r.series_id: r.driver_mask for r in got} == {k: v[1] for k, v in want.items()}
    assert all(r.criterion == pytest.approx(want[r.series_id][0], rel=1e-6) for r in got)


def test_best_of_twenty_drivers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 20))
    y = x[:, [2, 5, 11]] @ [3.0, -2.0, 1.5] + rng.normal(size=120)
    z = np.column_stack([np.ones(120), x, y])
    packed = spark.createDataFrame([("s", [float(v) for v in (z.T @ z)[np.triu_indices(22)]])], "series_id string, moments array<double>")
    got = arima.best_driver_subset(packed, tuple(f"x{i}" for i in range(20)), "bic").first()
    assert got.driver_mask & (1 << 2 | 1 << 5 | 1 << 11) == 1 << 2 | 1 << 5 | 1 << 11 and bin(got.driver_mask).count("1") <= 6


def test_subsets_come_from_a_spread_range(spark):
    long = spark.createDataFrame([(date(2020, 1, 1), f"x{i:02}", 1.0) for i in range(12)], "ds date, driver string, x double")
    got = explore.driver_subsets(long)
    assert got.count() == 4096 and got.agg(F.sum("size")).first()[0] == 12 * 2048 and got.where("mask = 5").first().drivers == ["x00", "x02"]
    assert got.rdd.getNumPartitions() > 1 and explore.driver_subsets(long.limit(0)).collect()[0].drivers == []


def test_search_orders_are_those_of_the_product(spark, monthly):
    packed = arima.frame_moments(arima.regression_frame(monthly.where("series_id = 'turning'"), None, CONFIG, SARIMA), len(arima.feature_names((), 12)))
    best = arima.search(packed, 12, 0).first()
    factors = arima.Factors(12, 0)
    assert np.allclose(best.weights, factors.weights(np.array([best.coef]))[0]) and len(best.weights) == factors.n_features

"""Start values of smoothing, and the status of series that cannot be forecast."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetcast.config import HOLT_WINTERS, ForecastConfig
from fleetcast.operators import smooth
from fleetcast.plans import status

MONTHS = [d.date() for d in pd.date_range("2015-01-01", periods=72, freq="MS")]
CONFIG = ForecastConfig(MONTHS[0], MONTHS[60], 12, "month", 12, drivers=("a", "b"))


def series(n: int = 60) -> np.ndarray:
    rng = np.random.default_rng(0)
    t = np.arange(n)
    return np.stack([100 + 1.5 * t + (10 + k) * np.sin(2 * np.pi * t / 12) + rng.normal(size=n) * 2 for k in range(6)])


@pytest.mark.parametrize("config", smooth.configurations(), ids=lambda c: f"{c['trend']}-{c['damped']}-{c['season']}-{c['box_cox']}")
def test_start_values_never_cost(config):
    y, m = series(), 12
    lam = np.full(len(y), 0.5) if config["box_cox"] else None
    z = y if lam is None else smooth._transform(y, lam[:, None])
    grid = np.repeat(smooth.parameter_grid(config)[None], len(y), axis=0)
    first = smooth.run(z, lam, config, m, grid)
    at = first["sse"].argmin(axis=1)
    search = smooth.Search(y, lam, config, m, grid[np.arange(len(y)), at])
    begun = search.loss.copy()
    assert np.allclose(begun, first["sse_raw"][np.arange(len(y)), at])
    for _ in range(6):
        before = search.loss.copy()
        search.round()
        assert (search.loss <= before).all()
    assert (search.loss < begun).all()
    exponent = search.point[:, -1] if config["box_cox"] else None
    z = y if exponent is None else smooth._transform(y, exponent[:, None])
    again = smooth.run(z, exponent, config, m, search.point[:, None, :4], keep=True, start=search.starts(search.point[:, None, :]))
    assert np.allclose(again["sse_raw"][:, 0], search.loss) and np.allclose(((y - again["fit"]) ** 2).sum(axis=1), search.loss)


@pytest.fixture(scope="module")
def mixed(spark):
    good = series(72)[0]
    rows = [("good", d, float(v)) for d, v in zip(MONTHS, good)] + [("gap", d, float(v)) for d, v in zip(MONTHS, good) if d != MONTHS[20]]
    rows += [("early", d, 1.0) for d in MONTHS[:50]] + [("late", d, 1.0) for d in MONTHS[61:]] + [("null", d, None if d == MONTHS[5] else 2.0) for d in MONTHS]
    rows += [("twice", d, 3.0) for d in MONTHS + MONTHS[:1]] + [("young", d, float(v)) for d, v in zip(MONTHS[30:], good[30:])]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def test_reasons(mixed):
    got = {r.series_id: r.reason for r in status.usability(mixed, CONFIG).collect()}
    assert got == {"good": None, "young": None, "gap": "gaps in the training window", "early": "ends before the forecast", "late": "no training rows",
                   "null": "missing values", "twice": "repeated dates"}


def test_every_series_has_a_row(mixed):
    out, params = smooth.holt_winters(mixed, CONFIG)
    got = status.with_status(mixed, CONFIG, out, HOLT_WINTERS).toPandas()
    assert set(got.series_id) == {"good", "young", "gap", "early", "late", "null", "twice"}
    done = got[got.status == "forecast"]
    assert set(done.series_id) == {"good", "young"} and not done.yhat.isna().any() and (done[done.kind == "pred"].groupby("series_id").size() == 12).all()
    skipped = got[got.status == "skipped"]
    assert len(skipped) == 5 and skipped.reason.notna().all() and skipped.yhat.isna().all()
    report = params.where("series_id = 'good'").toPandas().set_index("name")
    assert len(report) == 16 and report.text["saisonale Periode"] == "12" and report.text["remove_bias_opti"] == "false"


def test_start_values_reach_the_forecast(mixed):
    packed = smooth.packed_series(mixed, CONFIG)
    plain = smooth.fit_configurations(packed, CONFIG, 3, 0).select("series_id", "config_id", F.col("sse").alias("plain"))
    both = smooth.fit_configurations(packed, CONFIG, 3).join(plain, ["series_id", "config_id"]).toPandas()
    assert len(both) > 30 and (both.sse <= both.plain * (1 + 1e-9)).all() and (both.sse < both.plain * 0.9).any()
    states = smooth.final_states(smooth.chosen(packed, smooth.fit_configurations(packed, CONFIG)), CONFIG)
    fit = smooth.fitted(states).join(mixed, ["series_id", "ds"]).groupBy("series_id").agg(F.sum((F.col("yhat") - F.col("y")) ** 2).alias("e"))
    for r in fit.join(states.select("series_id", "sse"), "series_id").collect():
        assert r.e == pytest.approx(r.sse, rel=1e-6)
    assert date(2015, 1, 1) == MONTHS[0]

import math
from datetime import date

import pytest

from fleetcast.operators import metrics


def frame(spark, pairs):
    return spark.createDataFrame(
        [("s", "m", date(2020, 1, i + 1), y, f) for i, (y, f) in enumerate(pairs)],
        "series_id string, method string, ds date, y double, yhat double")


def test_plain_values(spark):
    r = metrics.score(frame(spark, [(10.0, 12.0), (20.0, 15.0)])).first()
    assert r.mae == 3.5 and r.mae_total == 3.0 and r.mae_min == 2.0 and r.mae_max == 5.0
    assert r.mape == 22.5 and r.mape_total == 10.0
    assert r.mfe == -1.5 and r.total_bias == -3.0 and r.rel_total_bias == -10.0
    assert r.mse == 14.5 and r.nmse == pytest.approx(0.29)
    assert r.rmse == pytest.approx(math.sqrt(14.5), abs=1e-4)


def test_zero_actual_is_infinite_and_zero_over_zero_has_no_value(spark):
    r = metrics.score(frame(spark, [(0.0, 1.0), (10.0, 10.0)])).first()
    assert r.mape == math.inf and r.mape_max == math.inf and r.mape_min == 0.0
    assert r.rel_mfe == math.inf and r.smape == 100.0
    r = metrics.score(frame(spark, [(0.0, 0.0), (10.0, 10.0)])).first()
    assert r.mape is None and r.mape_min is None and r.smape is None and r.mae == 0.0


def test_opposite_infinities_cancel_to_null(spark):
    r = metrics.score(frame(spark, [(0.0, 1.0), (0.0, -1.0)])).first()
    assert r.rel_mfe is None and r.mape == math.inf


def test_missing_actual_makes_aggregates_null_but_not_other_periods(spark):
    df = frame(spark, [(None, 1.0), (10.0, 11.0)])
    r = metrics.score(df).first()
    assert all(r[n] is None for n in metrics.aggregates())
    periods = {p.ds.day: p for p in metrics.score_periods(df).collect()}
    assert periods[1].mae is None and periods[2].mae == 1.0 and periods[2].bias == 1.0


def test_report_families(spark):
    report = metrics.report(frame(spark, [(10.0, 12.0)]))
    assert set(report) == {"MAPE", "SMAPE", "MAE", "MFPE", "MFE"}
    assert report["MFPE"][0].first().rel_mfe == 20.0

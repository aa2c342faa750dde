"""Trees and the complete run on the smallest tables."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast.catalog.base import MONTHLY, series_inputs
from fleetcast.catalog.files import workbook_files
from fleetcast.config import BOOSTING, HOLT_WINTERS, METHODS, MLR, RANDOM_FOREST, SARIMA
from fleetcast.operators import calendars, trees, validate
from fleetcast.plans.registry import METHOD_FUNCTIONS
from fleetcast.plans.run import ForecastRun
from fleetcast.sources import sinks, star, workbook


@pytest.fixture(scope="module")
def inputs(spark, folder):
    return series_inputs(spark, folder)


def test_spaces_have_the_full_number_of_candidates():
    assert trees.FOREST_SPACE.size == 36450 and trees.BOOSTING_SPACE.size == 87480


def test_draws_are_distinct_and_repeatable(spark):
    a = [r.config_id for r in trees.draw(spark, trees.BOOSTING_SPACE, 200).collect()]
    b = [r.config_id for r in trees.draw(spark, trees.BOOSTING_SPACE, 200).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 200


def test_refinement_covers_neighbors(spark):
    best = spark.createDataFrame([(0, 500, 4, 0.1, 1.0, 10.0, 1.0, 0.0)],
                                 "config_id int, trees int, depth int, rate double, child_weight double, gamma double, l2 double, l1 double")
    got = trees.refinement(best, 70.0).toPandas()
    assert len(got) == 5 * 3 * 4 * 3 * 3
    assert set(got.trees) == {400, 450, 500, 550, 600} and set(got.depth) == {3, 4, 5} and set(got.gamma) == {6.0, 10.0, 7.0}


def test_staged_boosting_errors_equal_separate_fits(inputs):
    data = trees.panel(*inputs, MONTHLY)[0].persist()
    space = trees.BOOSTING_SPACE
    cands = [dict(trees=n, depth=2, rate=0.1, child_weight=1.0, gamma=0.0, l2=0.0, l1=0.0) for n in (2, 4)]
    together = trees._boosting_errors(data, space, cands, 0.0, 2)
    apart = [trees._boosting_errors(data, space, [c], 0.0, 2)[0] for c in cands]
    data.unpersist()
    assert np.allclose(together, apart)


@pytest.mark.parametrize("space,method", [(trees.FOREST_SPACE, RANDOM_FOREST), (trees.BOOSTING_SPACE, BOOSTING)])
def test_tuned_trees(spark, inputs, space, method):
    tuned = trees.tune(*inputs, MONTHLY, trees.smaller(space, (4, 8)), trees.Budget(2, 2, 4))
    assert (tuned.stage == "refined") == (tuned.scores["refined"] <= tuned.scores["random"])
    imp = trees.importances(tuned, spark, method).collect()
    assert sum(r.value for r in imp) == pytest.approx(1.0) and {r.name for r in imp} == {*MONTHLY.drivers, *trees.SERIES_FEATURES}
    got = trees.forecast(tuned, *inputs, MONTHLY, method).where("kind = 'pred'").toPandas()
    assert not got.yhat.isna().any() and (got.groupby("series_id").size() == 12).all()


def test_every_method_is_registered():
    assert set(METHOD_FUNCTIONS) == set(METHODS)


@pytest.fixture(scope="module")
def run(inputs):
    product, drivers = inputs
    actual = calendars.horizon_rows(product, MONTHLY)
    scenarios = actual.select("series_id", "ds", F.lit("up").alias("scenario"), (F.col("y") * 1.05).alias("yhat")).unionByName(
        actual.select("series_id", "ds", F.lit("empty").alias("scenario"), F.lit(0.0).alias("yhat")))
    edits = drivers.where("ds = '2000-08-01'").select("ds", F.lit("n_orders").alias("driver"), (F.col("n_orders") * 2).alias("x"))
    config = replace(MONTHLY, methods=(MLR, HOLT_WINTERS, SARIMA), unit="Euro", run_name="run 1")
    return ForecastRun(product, drivers, config, scenarios, edits)


def test_blocked_series_are_named_and_left_out(run):
    blocked = {r.series_id for r in run.blocked.collect()}
    used = {r.series_id for r in run.product.select("series_id").distinct().collect()}
    assert used and not used & blocked


def test_forecast_of_all_methods(run):
    got = run.forecast.toPandas()
    n = run.product.select("series_id").distinct().count()
    pred = got[got.kind == "pred"]
    assert len(pred) == n * 12 * 3 and not pred.yhat.isna().any()
    assert np.allclose(got.yhat.dropna() * 100, (got.yhat.dropna() * 100).round(), atol=1e-6)


def test_scenarios_are_scored_like_methods(run):
    mape = run.metric_report()["MAPE"][0].toPandas()
    assert set(mape.method) == {MLR, HOLT_WINTERS, SARIMA, "up"}
    assert np.allclose(mape[mape.method == "up"].mape.dropna(), 5.0, atol=1e-3)


def test_exploration(run):
    assert run.decomposition().where("trend IS NOT NULL").count() > 0
    assert run.correlations().count() == 16
    assert run.contributions(MLR).where("name = 'Intercept'").count() > 0


def test_report_is_written_and_read_back(run, spark, tmp_path):
    written = run.write_report(str(tmp_path), ("csv", "parquet"))
    assert len(written) == 2 * 15
    back = spark.read.parquet(written["parquet:Metrik_MAE"])
    assert back.count() == run.metric_report()["MAE"][0].count()
    forecast = spark.read.option("header", True).option("sep", sinks.REPORT_SEPARATOR).csv(written["csv:Prognose"])
    assert forecast.columns == ["series_id", "Date", MLR, HOLT_WINTERS, SARIMA]


def test_incomplete_horizon_is_refused(inputs):
    product, drivers = inputs
    with pytest.raises(ValueError, match="horizon"):
        ForecastRun(product, drivers.where("ds < '2001-01-01'"), MONTHLY).drivers


def test_series_with_repeated_dates_are_blocked(inputs):
    product, drivers = inputs
    twice = product.unionByName(product.where("series_id = 'Brand#16'"))
    run = ForecastRun(twice, drivers, MONTHLY)
    reasons = {(r.series_id, r.reason) for r in run.blocked.collect()}
    assert ("Brand#16", "repeated dates") in reasons
    assert run.product.where("series_id = 'Brand#16'").isEmpty()
    assert validate.spacing_violations(twice).where("series_id = 'Brand#16' AND gap_days = 0").count() == 1


def test_large_dimensions_take_the_shuffle_path(spark, folder):
    """The same series without any broadcast join."""
    want = [star.product_monthly(spark, folder).toPandas(), star.product_fleet(spark, folder).toPandas()]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [star.product_monthly(spark, folder).toPandas(), star.product_fleet(spark, folder).toPandas()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for a, b in zip(want, got):
        key = ["series_id", "ds"]
        assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_bad_settings_are_refused(inputs):
    with pytest.raises(ValueError, match="drivers"):
        ForecastRun(*inputs, replace(MONTHLY, drivers=("n_orders", "nothing")))
    with pytest.raises(ValueError, match="run name"):
        ForecastRun(*inputs, replace(MONTHLY, run_name="a/b"))


def test_workbook_folder(spark, inputs, tmp_path):
    one = inputs[0].where("series_id = 'Brand#1'")
    row = workbook_files(one).first()
    (tmp_path / "a.xlsx").write_bytes(bytes(row.content))
    cells = workbook.read_workbooks(spark, str(tmp_path))
    assert workbook.cells_to_long(cells).count() == one.count()

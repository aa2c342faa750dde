from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fleetcast.catalog.base import MONTHLY
from fleetcast.config import ForecastConfig
from fleetcast.operators import calendars, validate, windows
from fleetcast.sources import text

SCHEMA = "series_id string, ds date, y double"


def test_granularity_rules(spark):
    rows = [("m", date(2020, 1, 1), 1.0), ("m", date(2020, 2, 1), 1.0), ("d", date(2020, 1, 1), 1.0), ("d", date(2020, 1, 2), 1.0),
            ("w", date(2020, 1, 1), 1.0), ("w", date(2020, 1, 8), 1.0), ("one", date(2020, 1, 1), 1.0),
            ("twice", date(2020, 1, 1), 1.0), ("twice", date(2020, 1, 1), 2.0), ("twice", date(2020, 2, 1), 2.0)]
    got = {r.series_id: r.gran for r in validate.infer_granularity(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"m": "month", "d": "day", "w": None, "one": None, "twice": None}


def test_first_irregular_pair_is_reported(spark):
    days = [0, 1, 2, 4, 5, 8]
    rows = [("d", date(2020, 1, 1) + timedelta(days=i), 1.0) for i in days]
    r = validate.spacing_violations(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.from_ds, r.to_ds, r.gap_days, r.violations) == (date(2020, 1, 3), date(2020, 1, 5), 2, 2)


def test_complete_calendar_fills_leap_february(spark):
    rows = [("m", date(2020, 1, 1), 1.0), ("m", date(2020, 3, 1), 3.0)]
    got = calendars.complete_calendar(spark.createDataFrame(rows, SCHEMA), "month").orderBy("ds").collect()
    assert [(r.ds, r.y) for r in got] == [(date(2020, 1, 1), 1.0), (date(2020, 2, 1), None), (date(2020, 3, 1), 3.0)]


def test_month_ends_follow_the_gregorian_calendar(spark):
    rows = [("m", date(1900, 1, 1), 1.0), ("m", date(1900, 2, 1), 3.0)]
    got = calendars.next_periods(spark.createDataFrame(rows, SCHEMA), "month", 2).orderBy("ds").collect()
    assert [r.ds for r in got] == [date(1900, 3, 1), date(1900, 4, 1)]


def test_number_texts(spark):
    df = spark.createDataFrame([("a", "1.5"), ("b", "n/a"), ("c", ""), ("d", "x1"), ("e", "-0.0"), ("f", None)], "k string, t string")
    got = {r.k: r.v for r in df.select("k", validate.to_number(F.col("t")).alias("v")).collect()}
    assert got == {"a": 1.5, "b": None, "c": None, "d": None, "e": 0.0, "f": None}
    assert str(got["e"]) == "0.0"
    assert [r.k for r in validate.text_cells(df, "k", "t").collect()] == ["d"]


def test_whitespace_and_csv_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date  p1 p2\n01-02-2020   1.5  2\n01.03.2020 NaN 4\n")
    (tmp_path / "b.csv").write_text("Date,p1,Unnamed: 2\n01/02/2020,1.5,\n,2.0,\n")
    txt = validate.typed_long(text.wide_to_long(text.read_table(spark, str(tmp_path / "a.txt")))).collect()
    assert {(r.series_id, r.ds, r.y) for r in txt} == {
        ("p1", date(2020, 2, 1), 1.5), ("p2", date(2020, 2, 1), 2.0), ("p1", date(2020, 3, 1), None), ("p2", date(2020, 3, 1), 4.0)}
    csv = validate.typed_long(text.wide_to_long(text.read_table(spark, str(tmp_path / "b.csv")))).collect()
    assert [(r.series_id, r.ds, r.y) for r in csv] == [("p1", date(2020, 2, 1), 1.5)]


def test_scenarios_need_name_and_nonzero_values(spark):
    first, second = date(2020, 6, 1), date(2020, 7, 1)
    dated = {"short": (first,), "past": (date(1980, 1, 1), date(1980, 2, 1)), "twice": (first, first)}
    rows = [("s", n, ds, 0.0 if n == "zero" else v) for n in ("ok", "", "zero", "short", "past", "twice") for ds, v in zip(dated.get(n, (first, second)), (1.0, 2.0))]
    config = ForecastConfig(date(2018, 1, 1), first, 2, "month", drivers=("a", "b"))
    got = {r.scenario: r.accepted for r in validate.scenario_check(
        spark.createDataFrame(rows, "series_id string, scenario string, ds date, yhat double"), config).collect()}
    assert got == {"ok": True, "": False, "zero": False, "short": False, "past": False, "twice": False}


def test_complete_calendar_keeps_repeated_dates(spark):
    rows = [("s", date(2020, 1, 1), 1.0), ("s", date(2020, 1, 1), 2.0), ("s", date(2020, 4, 1), 3.0)]
    got = calendars.complete_calendar(spark.createDataFrame(rows, SCHEMA), "month").collect()
    assert sorted((r.ds.month, r.y or 0.0) for r in got) == [(1, 1.0), (1, 2.0), (2, 0.0), (3, 0.0), (4, 3.0)]


@pytest.mark.parametrize("name,ok", [("Lauf 1_a-b", True), ("größer", True), ("a/b", False), ("a.b", False), ("", False)])
def test_run_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "n string").select(validate.valid_run_name(F.col("n"))).first()[0] is ok


def test_config_problems():
    assert MONTHLY.problems() == []
    bad = ForecastConfig(date(2020, 1, 1), date(2020, 6, 1), 0, unit="kg", drivers=("a",), methods=("?",))
    assert len(bad.problems()) == 5
    assert ForecastConfig(date(2020, 1, 1), date(2020, 1, 8), 7, "day").season_length == 7


def test_fold_sizes_put_the_remainder_first(spark):
    rows = [("s", date(2020, 1, 1) + timedelta(days=i), 1.0) for i in range(13)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fold", windows.contiguous_fold(5))
    assert [r["count"] for r in df.groupBy("fold").count().orderBy("fold").collect()] == [3, 3, 3, 2, 2]


def test_lag_names_and_dropped_rows(spark):
    rows = [("s", date(2020, 1, 1) + timedelta(days=i), float(i)) for i in range(5)]
    out = windows.lag_features(spark.createDataFrame(rows, SCHEMA), ("y",), (1, 2)).orderBy("ds")
    assert out.columns == ["series_id", "ds", "y(t-1)", "y(t-2)", "y(t)"]
    assert out.count() == 3 and out.first()["y(t-2)"] == 0.0

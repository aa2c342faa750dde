"""Written tables and who removes them."""

import os

import pytest

from fleetcast import session
from fleetcast.catalog import QUERIES


def found(folder: str) -> bool:
    return os.path.exists(folder.removeprefix("file://").removeprefix("file:"))


def test_tables_go_with_their_run(spark, folder):
    with session.owned_tables(spark) as run:
        rows = QUERIES["r3_ridge_accuracy" if "r3_ridge_accuracy" in QUERIES else "r1_mlr_accuracy"](spark, folder).collect()
        assert rows and found(run) and spark.read.json(f"{run}/manifest").count() == 2
        assert session.scratch_folder(spark, "x").startswith(run)
    assert not found(run) and not session.scratch_folder(spark, "x").startswith(run)


def test_tables_go_after_a_failure_and_stay_on_request(spark):
    with pytest.raises(ZeroDivisionError):
        with session.owned_tables(spark) as run:
            session.materialize(spark.range(3), "t")
            raise ZeroDivisionError
    assert not found(run)
    with session.owned_tables(spark, keep=True) as kept:
        session.materialize(spark.range(3), "t")
    assert found(kept)
    session.remove_folder(spark, kept)
    assert not found(kept)

"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import math

import pandas as pd
import pytest

from fleetcast.catalog import ORACLES, QUERIES


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if hasattr(v, "strftime"):
            return v.strftime("%Y-%m-%d")
        v = v.item() if hasattr(v, "item") else v
        return repr(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

"""Forecast accuracy: one projection per period, one grouped aggregation per series and method.

Input is a relation of actual ``y`` and forecast ``yhat`` matched by date. An average over
a period without an actual is NULL, as is a minimum or maximum over periods of which one
cannot be computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetcast.functions.scalars import finite_or_null, ratio, rounded, signed_ratio
from fleetcast.session import materialize

KEYS = ["series_id", "method"]


def y() -> Column:
    return F.col("y")


def yhat() -> Column:
    return F.col("yhat")


def error() -> Column:
    return yhat() - y()


def percentage() -> Column:
    return ratio(F.abs(error()), F.abs(y())) * 100


def symmetric() -> Column:
    # 0/0 has no value and makes the average NULL.
    return ratio(F.abs(error()), (F.abs(y()) + F.abs(yhat())) / 2) * 100


def relative() -> Column:
    return signed_ratio(error(), y()) * 100


def _complete(value: Column, per_period: Column | None = None) -> Column:
    """``value`` unless a period of the group lacks an input."""
    probe = error() if per_period is None else per_period
    return F.when(F.count_if(probe.isNull()) == 0, finite_or_null(value))


def _mean(per_period: Column) -> Column:
    return rounded(_complete(F.avg(per_period), per_period))


def _least(per_period: Column) -> Column:
    return _complete(F.min(rounded(per_period)), per_period)


def _most(per_period: Column) -> Column:
    return _complete(F.max(rounded(per_period)), per_period)


def aggregates() -> dict[str, Column]:
    """Every aggregate metric by name. Columns are built on call: they need a session."""
    sum_y, sum_f = F.sum(y()), F.sum(yhat())
    mse = F.avg(error() * error())
    rms = lambda c: F.sqrt(F.avg(c * c))
    return {
        "mae": _mean(F.abs(error())),
        "mae_total": rounded(_complete(F.abs(sum_y - sum_f))),
        "mae_min": _least(F.abs(error())),
        "mae_max": _most(F.abs(error())),
        "mse": rounded(_complete(mse)),
        "rmse": rounded(_complete(F.sqrt(mse))),
        "smape": _mean(symmetric()),
        "smape_total": rounded(_complete(ratio(F.abs(sum_y - sum_f), (F.abs(sum_y) + F.abs(sum_f)) / 2) * 100)),
        "smape_min": _least(symmetric()),
        "smape_max": _most(symmetric()),
        "mape": _mean(percentage()),
        "mape_total": rounded(_complete(ratio(F.abs(sum_y - sum_f), F.abs(sum_y)) * 100)),
        "mape_min": _least(percentage()),
        "mape_max": _most(percentage()),
        "mfe": _mean(error()),
        "rel_mfe": _mean(relative()),
        "total_bias": rounded(_complete(F.sum(error()))),
        "rel_total_bias": rounded(_complete(signed_ratio(F.sum(error()), sum_y) * 100)),
        "nmse": rounded(_complete(ratio(mse, F.var_samp(y())))),
        "theil_u": _complete(ratio(rms(error()), rms(yhat()) + rms(y()))),
    }


def per_period() -> dict[str, Column]:
    return {
        "mae": rounded(F.abs(error())),
        "smape": rounded(symmetric()),
        "mape": rounded(percentage()),
        "bias": rounded(error()),
        "rel_bias": rounded(relative()),
    }


# Report families, each an aggregate table and a per-period table.
FAMILIES = {
    "MAPE": (("mape", "mape_total", "mape_min", "mape_max"), "mape"),
    "SMAPE": (("smape", "smape_total", "smape_min", "smape_max"), "smape"),
    "MAE": (("mae", "mae_total", "mae_min", "mae_max"), "mae"),
    "MFPE": (("rel_mfe", "rel_total_bias"), "rel_bias"),
    "MFE": (("mfe", "total_bias"), "bias"),
}
FIT_METRICS = ("mape", "mape_total", "mae", "mae_total", "smape", "smape_total")


def score(joined: DataFrame, names: tuple[str, ...] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """One row per series and method with the named metrics (default: all)."""
    every = aggregates()
    return joined.groupBy(*keys).agg(*[every[n].alias(n) for n in (names or every)])


def score_periods(joined: DataFrame, names: tuple[str, ...] | None = None, keys: list[str] = KEYS) -> DataFrame:
    every = per_period()
    return joined.select(*keys, "ds", *[every[n].alias(n) for n in (names or every)])


def report(joined: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per family: (aggregate table, per-period table), selected from two written tables: the rows are read twice in all."""
    whole = materialize(score(joined, tuple(n for names, _ in FAMILIES.values() for n in names)), "metrics")
    single = materialize(score_periods(joined, tuple(one for _, one in FAMILIES.values())), "metrics-by-period")
    return {f: (whole.select(*KEYS, *names), single.select(*KEYS, "ds", one)) for f, (names, one) in FAMILIES.items()}

"""Moment matrices: the one aggregation all linear methods are solved from.

For a row ``v = (1, z1 ... zk, y)`` the moment matrix is the sum of ``v v'``. It is a plain
grouped sum with map-side partial aggregation: a series of any length becomes
``(k + 2)(k + 3) / 2`` numbers, per fold, and every fold, penalty and driver subset is
computed from those numbers without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.config import ForecastConfig
from fleetcast.operators.calendars import training
from fleetcast.operators.windows import contiguous_fold, lag_features
from fleetcast.session import by_series

WALK_FORWARD_TEST_ROWS = 12


def design(product: DataFrame, drivers: DataFrame, config: ForecastConfig) -> tuple[DataFrame, tuple[str, ...]]:
    """Product rows next to the driver values of their date, and the feature names.

    With lags the driver table is lagged as a whole, so training and horizon rows get
    lagged values alike and stay matched by date.
    """
    names = config.drivers
    table = drivers.select("ds", *names)
    if config.lags:
        # The shared driver table has one row per period: a calendar-sized window.
        table = lag_features(table.withColumn("scope", F.lit("drivers")), names, config.lags, "scope").drop("scope")
        names = tuple(c for c in table.columns if c != "ds")
    return product.join(table, "ds"), names


def scaled(train: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Drivers standardized over the whole training window, target centered.

    A constant driver keeps scale 1. Rows without the target or a driver take no part, so all sums are over the same rows.
    """
    train = train.dropna(subset=["y", *names])
    w = Window.partitionBy("series_id")
    stats = {}
    for i, n in enumerate(names):
        sd = F.stddev_pop(F.col(f"`{n}`")).over(w)
        stats |= {f"_m{i}": F.avg(F.col(f"`{n}`")).over(w), f"_s{i}": F.when(sd > 0, sd).otherwise(1.0)}
    out = train.withColumns(stats)
    zs = [((F.col(f"`{n}`") - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(f"_z{i}") for i, n in enumerate(names)]
    return out.withColumn("_my", F.avg("y").over(w)).select(
        "series_id", "ds", *zs, (F.col("y") - F.col("_my")).alias("_y"), *scale_names(len(names)))


def scale_names(k: int) -> list[str]:
    """Columns of :func:`scaled` that are constant within a series."""
    return ["_my", *[f"_m{i}" for i in range(k)], *[f"_s{i}" for i in range(k)]]


def scale_aggregates(k: int) -> list[Column]:
    """Those constants through an aggregation; scalars keep it a hash aggregation."""
    return [F.first(c).alias(c) for c in scale_names(k)]


def scale_arrays(k: int) -> list[Column]:
    """``y_mean``, and ``mean`` and ``scale`` as arrays over the drivers."""
    return [F.col("_my").alias("y_mean"), F.array(*[F.col(f"_m{i}") for i in range(k)]).alias("mean"),
            F.array(*[F.col(f"_s{i}") for i in range(k)]).alias("scale")]


def moment_columns(values: list[str]) -> dict[str, Column]:
    """Sums of the upper triangle of the moment matrix of ``(1, *values)``, row by row.

    ``values`` are SQL expressions: parsed texts instead of thousands of column calls.
    """
    v = ["1D", *values]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    return {f"_p{n}": F.expr(f"sum({v[i]} * {v[j]}) AS _p{n}") for n, (i, j) in enumerate(pairs)}


def moments(values: list[str]) -> Column:
    """The same sums as one array."""
    v = ["1D", *values]
    return F.expr("array(" + ", ".join(f"sum({v[i]} * {v[j]})" for i in range(len(v)) for j in range(i, len(v))) + ")")


def series_moments(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.groupBy("series_id").agg(moments([f"`{c}`" for c in columns]).alias("moments"))


def fold_moments(product: DataFrame, drivers: DataFrame, config: ForecastConfig) -> tuple[DataFrame, tuple[str, ...]]:
    """``(series_id, y_mean, mean, scale, folds)``: moments of every test fold.

    ``folds`` is ordered by fold number. For walk-forward folds, the last entry holds the
    rows before the first test block.
    """
    rows, names = design(product, drivers, config)
    frame = scaled(by_series(training(rows, config)), names)
    k = config.cv_folds
    if config.walk_forward:
        back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ds")))
        fold = F.least(F.ceil(back / F.lit(WALK_FORWARD_TEST_ROWS)), F.lit(k + 1)).cast("int")
    else:
        fold = contiguous_fold(k)
    values = [f"_z{i}" for i in range(len(names))] + ["_y"]
    n = len(names)
    sums = moment_columns(values)
    per_fold = frame.withColumn("fold", fold).groupBy("series_id", "fold").agg(*sums.values(), *scale_aggregates(n))
    packed = per_fold.groupBy("series_id").agg(
        F.collect_list(F.struct("fold", F.array(*sums).alias("m"))).alias("folds"), *scale_aggregates(n))
    ordered = F.transform(F.array_sort("folds"), lambda f: f["m"]).alias("folds")
    return packed.select("series_id", *scale_arrays(n), ordered), names

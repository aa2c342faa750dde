"""Decomposition, outliers and correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.config import OUTLIER_Z, STRONG_CORRELATION
from fleetcast.operators.calendars import position


def moving_average(value: Column, m: int, key: str = "series_id") -> Column:
    """Mean of ``m`` neighbors, ``m // 2`` of them before; NULL where the frame is cut."""
    frame = Window.partitionBy(key).orderBy("ds").rowsBetween(-(m // 2), m - 1 - m // 2)
    return F.when(F.count(value).over(frame) == m, F.avg(value).over(frame))


def decompose(product: DataFrame, m: int, key: str = "series_id") -> DataFrame:
    """Additive parts: moving-average trend, mean deviation per cycle position, rest.

    All windows share the series key, so one shuffle serves them.
    """
    parts = product.withColumn("trend", moving_average(F.col("y"), m, key)).withColumn("pos", position(key) % m)
    deviation = F.col("y") - F.col("trend")
    # Sorting by (series, position) inside the partitions the trend already made: the
    # position is part of the order only, so no second shuffle is needed.
    seasonal = F.avg(deviation).over(Window.partitionBy(key, "pos"))
    return (
        parts.withColumn("seasonal", seasonal)
        .withColumn("rest", F.col("y") - F.col("trend") - F.col("seasonal"))
        .drop("pos")
    )


def outliers(parts: DataFrame, key: str = "series_id", cutoff: float = OUTLIER_Z) -> DataFrame:
    """Standard score of the rest and a flag beyond the cutoff."""
    w = Window.partitionBy(key)
    spread = F.stddev_samp("rest").over(w)
    z = F.when(spread > 0, (F.col("rest") - F.avg("rest").over(w)) / spread)
    return parts.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > cutoff, F.lit(False)))


def correlations(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Full correlation matrix in long form, pairwise complete.

    One aggregation over the wide table computes all pairs; no pair of rows is formed.
    """
    pairs = list(combinations_with_replacement(names, 2))
    one_row = wide.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2"), F.col(f"r{i}").alias("r")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("d1"), F.lit(a).alias("d2"), F.col(f"r{i}").alias("r")))
    return one_row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def strong_pairs(matrix: DataFrame, names: tuple[str, ...], cutoff: float = STRONG_CORRELATION) -> DataFrame:
    """Pairs of different drivers with a correlation of at least the cutoff, strongest first."""
    order = {n: i for i, n in enumerate(names)}
    rank = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))])
    return (
        matrix.where((rank[F.col("d1")] < rank[F.col("d2")]) & (F.abs("r") >= cutoff))
        .orderBy(F.abs("r").desc(), "d1", "d2")
    )


def driver_subsets(drivers_long: DataFrame) -> DataFrame:
    """Every subset of the drivers as a bitmask and an array; the masks are a range that Spark deals out, at most 62 drivers."""
    names = sorted(r[0] for r in drivers_long.select("driver").distinct().where("driver IS NOT NULL").collect())  # one per driver column
    if len(names) > 62:
        raise ValueError(f"{len(names)} drivers have too many subsets")
    masks = drivers_long.sparkSession.range(1 << len(names)).withColumnRenamed("id", "mask")
    held = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]
    drivers = F.array_compact(F.array(*held)) if names else F.array().cast("array<string>")
    return masks.select("mask", drivers.alias("drivers"), F.size(drivers).cast("long").alias("size"))

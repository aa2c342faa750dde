"""Seasonal-trend decomposition by local regression (Cleveland et al., 1990).

Without robustness weights every step is linear in the data, so for a given length the
whole procedure is one pair of matrices. They are built once per length in a task and
applied to all series of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetcast.session import by_series

# Cycle-subseries span and number of inner passes.
SEASONAL_SPAN = 7
INNER_PASSES = 5


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def loess_matrix(n: int, span: int, at: np.ndarray) -> np.ndarray:
    """Weights that give the local linear fit at positions ``at`` from ``n`` equispaced values."""
    x = np.arange(n, dtype=float)
    out = np.zeros((len(at), n))
    for row, x0 in enumerate(np.asarray(at, dtype=float)):
        dist = np.abs(x - x0)
        q = min(span, n)
        width = np.sort(dist)[q - 1]
        if span > n:
            width += (span - n) // 2
        near = np.argsort(dist, kind="stable")[:q]
        w = np.zeros(n)
        w[near] = np.clip(1 - (dist[near] / max(width, 1e-12)) ** 3, 0, None) ** 3
        w[dist <= 0.001 * width] = 1.0
        if w.sum() <= 0:
            w[near] = 1.0
        w /= w.sum()
        center = w @ x
        spread = w @ (x - center) ** 2
        if np.sqrt(spread) > 0.001 * (n - 1):
            w = w * (1 + (x0 - center) * (x - center) / spread)
        out[row] = w
    return out


def _averages(n: int, m: int) -> np.ndarray:
    out = np.zeros((n - m + 1, n))
    for i in range(n - m + 1):
        out[i, i:i + m] = 1.0 / m
    return out


def stl_matrices(n: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """``(S, T)`` with seasonal ``S y`` and trend ``T y`` for a series of length ``n``."""
    trend_span = _odd(1.5 * period / (1 - 1.5 / SEASONAL_SPAN))
    low_span = _odd(period + 1) if (period + 1) % 2 == 0 else period + 1
    # Cycle subseries, each extended by one period at both ends.
    cycle = np.zeros((n + 2 * period, n))
    for p in range(period):
        idx = np.arange(p, n, period)
        cycle[p::period][:len(idx) + 2, idx] = loess_matrix(len(idx), SEASONAL_SPAN, np.arange(-1, len(idx) + 1))
    low = loess_matrix(n, low_span, np.arange(n)) @ _averages(n + 2, 3) @ _averages(n + period + 1, period) @ _averages(n + 2 * period, period)
    to_season = cycle[period:period + n] - low @ cycle
    to_trend = loess_matrix(n, trend_span, np.arange(n))
    eye = np.eye(n)
    seasonal, trend = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(INNER_PASSES):
        seasonal = to_season @ (eye - trend)
        trend = to_trend @ (eye - seasonal)
    return seasonal, trend


def decompose(product: DataFrame, period: int, key: str = "series_id") -> DataFrame:
    """``(key, ds, y, trend, seasonal, rest)``; series shorter than two periods are left out.

    A series is calendar-sized (one value per period), so one row can hold it.
    """
    packed = by_series(product, key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("rows")).where(
        (F.size("rows") >= 2 * period) & ~F.exists("rows", lambda r: r["y"].isNull()))
    series = packed.select(key, F.col("rows.ds").alias("ds"), F.col("rows.y").alias("y"))

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = {}
        for page in pages:
            for n, group in page.groupby(page["y"].map(len)):
                if n not in built:
                    built[n] = stl_matrices(int(n), period)
                s, t = built[n]
                y = np.stack(group["y"].to_numpy())
                out = group[[key, "ds", "y"]].copy()
                out["seasonal"], out["trend"] = list(y @ s.T), list(y @ t.T)
                yield out

    parts = series.mapInPandas(batches, f"{key} string, ds array<date>, y array<double>, seasonal array<double>, trend array<double>")
    rows = parts.select(key, F.explode(F.arrays_zip("ds", "y", "trend", "seasonal")).alias("p")).select(key, "p.*")
    return rows.withColumn("rest", F.col("y") - F.col("trend") - F.col("seasonal"))

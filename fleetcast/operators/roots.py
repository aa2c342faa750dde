"""Differencing orders: Dickey-Fuller, Phillips-Perron and Canova-Hansen statistics from grouped sums.

Every statistic is a function of moment matrices of a series' lags, which are sums over lag windows with map-side
aggregation; only the small systems are solved in batches. All difference levels are tested at once, a level being one more key;
the order is the first level whose statistic does not ask for another difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.operators.gram import moments
from fleetcast.operators.solvers import unpack

# 5 % critical points by sample size, for regressions with constant and trend.
SAMPLE_SIZES = (25, 50, 100, 250, 500, 100000)
ADF_CRITICAL = (-3.60, -3.50, -3.45, -3.43, -3.42, -3.41)
PP_CRITICAL = (-17.9, -19.8, -20.7, -21.3, -21.5, -21.8)
# 5 % critical points of the Canova-Hansen statistic for seasons of 2 to 12 periods, of some longer ones, and the rule between.
CH_CRITICAL = (0.4617146, 0.7479655, 1.0007818, 1.2375350, 1.4625240, 1.6920200, 1.9043096, 2.1169602, 2.3268562, 2.5406922, 2.7391007)
CH_LONGER = {24: 5.098624, 52: 10.341416, 365: 65.44445}
CH_RULE = (0.269, 0.928)

LEAST_ROWS = 12  # a shorter series is not tested


def ch_critical(m: int) -> float:
    if 2 <= m <= 12:
        return CH_CRITICAL[m - 2]
    return CH_LONGER.get(m, CH_RULE[0] * m ** CH_RULE[1])


def levels(rows: DataFrame, lag: int, count: int) -> DataFrame:
    """``(series_id, level, t, n, y)``: the series differenced ``level`` times at ``lag``, for ``count`` levels; ``t`` counts from 1."""
    w = Window.partitionBy("series_id").orderBy("ds")
    out = rows.select("series_id", "ds", F.col("y").alias("y0"))
    for i in range(1, count):
        out = out.withColumn(f"y{i}", F.col(f"y{i - 1}") - F.lag(f"y{i - 1}", lag).over(w))
    out = out.select("series_id", "ds", F.inline(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"y{i}").alias("y")) for i in range(count)]))).where("y IS NOT NULL")
    group = Window.partitionBy("series_id", "level")
    return out.select("series_id", "level", "y", F.row_number().over(group.orderBy("ds")).alias("t"), F.count("*").over(group).alias("n"))


def _past(name: str, reach: int, group: list[str]) -> Column:
    """Earlier values, latest first."""
    return F.reverse(F.collect_list(name).over(Window.partitionBy(*group).orderBy("t").rowsBetween(-reach, -1)))


def _standard(rows: DataFrame) -> DataFrame:
    """``y`` with mean 0 and deviation 1 in each group, which changes no unit-root statistic; constant series have ``flat``."""
    w = Window.partitionBy("series_id", "level")
    sd = F.stddev_pop("y").over(w)
    rows = rows.withColumn("flat", F.max("y").over(w) == F.min("y").over(w))
    return rows.withColumn("y", F.when(F.col("flat"), 0.0).otherwise((F.col("y") - F.avg("y").over(w)) / sd))


def adf_lags(n: Column | int):
    """Lagged differences and level in the Dickey-Fuller regression: the integer part of the cube root of ``n - 1``, and one."""
    return int(round((n - 1) ** (1 / 3), 9)) + 1 if isinstance(n, int) else F.floor(F.round(F.pow(n - 1, F.lit(1 / 3)), 9)).cast("int") + 1


def pp_width(n: Column | int):
    """Width of the Bartlett window of the Phillips-Perron statistic for ``n`` changes."""
    return int(4 * (n / 100) ** 0.25) if isinstance(n, int) else F.floor(4 * F.pow(n / 100, F.lit(0.25))).cast("int")


def unit_root_moments(rows: DataFrame, longest: int) -> DataFrame:
    """``(series_id, level, n, flat, k, width, adf, pp, cross)``: the sums that both unit-root statistics are computed from.

    ``rows`` come from :func:`levels`; ``longest`` is the length of the longest series. ``cross`` has the sums of products of a row with an
    earlier one, by distance.
    """
    most, wide = adf_lags(longest), pp_width(longest)
    frame = _standard(rows).withColumn("past", _past("y", max(most, wide) + 1, ["series_id", "level"]))
    frame = frame.withColumns({"k": adf_lags(F.col("n")), "width": pp_width(F.col("n") - 1), "u": F.col("t").cast("double") / F.col("n"), "s": F.col("t") - F.lit(1.0)})
    changes = [f"CASE WHEN k > {j} THEN get(past, {j - 1}) - get(past, {j}) ELSE 0D END" for j in range(1, most)]
    late = "(t > k)"
    adf = ["get(past, 0)", "u", *changes, "y - get(past, 0)"]
    adf_sums = moments([f"CASE WHEN {late} THEN {v} ELSE 0D END" for v in adf])
    pp = [f"CASE WHEN t > 1 THEN {v} ELSE 0D END" for v in ("s", "get(past, 0)", "y")]
    cross = []
    for j in range(1, max(wide, 1) + 1):
        now, before = ("1D", "s", "get(past, 0)", "y"), ("1D", f"(s - {j})", f"get(past, {j})", f"get(past, {j - 1})")
        cross += [f"sum(CASE WHEN t > {j + 1} THEN {a} * {b} ELSE 0D END)" for a in now for b in before]
    return frame.groupBy("series_id", "level").agg(
        F.first("n").alias("n"), F.first("flat").alias("flat"), F.first("k").alias("k"), F.first("width").alias("width"), adf_sums.alias("adf"),
        F.count_if(F.col("t") > F.col("k")).alias("adf_rows"), moments(pp).alias("pp"), F.expr("array(" + ", ".join(cross) + ")").alias("cross"))


def _adf(flat: np.ndarray, rows: int, k: int) -> float:
    """t statistic of the lagged level in the regression of changes on it, a trend, a constant and ``k - 1`` earlier changes."""
    m = unpack(flat)
    m[0, 0] = rows
    used = [0, 1, 2, *range(3, 2 + k)]
    if rows <= len(used):
        return -np.inf
    a, c = m[np.ix_(used, used)], m[used, -1]
    inv = np.linalg.pinv(a, hermitian=True)
    b = inv @ c
    sigma2 = (m[-1, -1] - b @ c) / (rows - len(used))
    err = np.sqrt(max(sigma2 * inv[1, 1], 0.0))
    return float(b[1] / err) if err > 0 else -np.inf


def _pp(flat: np.ndarray, cross: np.ndarray, n: int, width: int) -> float:
    """Normalized bias of the lagged level with a long-run variance of the residuals."""
    m = unpack(flat)
    m[0, 0] = n
    b = np.linalg.pinv(m[:3, :3], hermitian=True) @ m[:3, 3]
    r = np.r_[-b, 1.0]
    var = r @ m @ r / n
    lagged = cross.reshape(-1, 4, 4)
    long_run = var + 2 / n * sum((1 - j / (width + 1)) * (r @ lagged[j - 1] @ r) for j in range(1, width + 1))
    s, st, ss = m[0, 2], m[1, 2], m[2, 2]
    spread = n * n * (n * n - 1) * ss / 12 - n * st ** 2 + n * (n + 1) * st * s - n * (n + 1) * (2 * n + 1) * s ** 2 / 6
    return float(n * (b[2] - 1) - n ** 6 / (24 * spread) * (long_run - var)) if spread > 0 else -np.inf


def unit_roots(rows: DataFrame, limit: int, longest: int) -> DataFrame:
    """``(series_id, level, n, adf, pp, adf_critical, pp_critical)`` for each number of differences below ``limit``; no statistic where a level is short or constant."""
    packed = unit_root_moments(levels(rows, 1, limit), longest)

    def solve(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            tested = [not f and n >= LEAST_ROWS for f, n in zip(page["flat"], page["n"])]
            adf = [_adf(a, r, k) if ok else None for a, r, k, ok in zip(page["adf"], page["adf_rows"], page["k"], tested)]
            pp = [_pp(p, c, n - 1, w) if ok else None for p, c, n, w, ok in zip(page["pp"], page["cross"], page["n"], page["width"], tested)]
            points = {name: np.interp(page["n"], SAMPLE_SIZES, p) for name, p in (("adf_critical", ADF_CRITICAL), ("pp_critical", PP_CRITICAL))}
            yield page[["series_id", "level", "n"]].assign(adf=adf, pp=pp, **points)

    return packed.mapInPandas(solve, "series_id string, level int, n long, adf double, pp double, adf_critical double, pp_critical double")


def _first_settled(stops: Column, limit: int) -> Column:
    """The least level that needs no further difference; ``limit`` if each does."""
    return F.coalesce(F.min(F.when(stops, F.col("level"))), F.lit(limit)).cast("int")


def unit_root_orders(rows: DataFrame, limit: int, longest: int) -> DataFrame:
    """``(series_id, d_adf, d_pp)``: how often a series is differenced until the unit root is rejected."""
    stats = unit_roots(rows, limit, longest)
    return stats.groupBy("series_id").agg(*[
        _first_settled(F.col(t).isNull() | (F.col(t) < F.col(f"{t}_critical")), limit).alias(f"d_{t}") for t in ("adf", "pp")])


def harmonics(m: int) -> list[list[float]]:
    """Seasonal cosines and sines by place in the season: ``m - 1`` values for each of ``m`` places."""
    waves = [(f, k) for k in range(1, m // 2 + 1) for f in ((np.cos,) if 2 * k == m else (np.cos, np.sin))]
    return [[float(f(2 * np.pi * k * t / m)) for f, k in waves] for t in range(1, m + 1)]


def ch_lags(n: int, m: int) -> int:
    """Lags of the long-run covariance."""
    return int(round(m * (n / 100) ** 0.25))


def seasonal_stability(rows: DataFrame, m: int, limit: int, longest: int) -> DataFrame:
    """``(series_id, level, n, statistic)`` of Canova and Hansen (1995) for each number of seasonal differences below ``limit``.

    The series is regressed on a constant and all seasonal harmonics, which is to take away the mean of each season. Harmonics
    times residuals are added up along the series; the statistic compares the spread of these sums with their long-run covariance
    (Bartlett weights). It is large where the season changes. NULL where the covariance is singular or a season is not seen twice.
    """
    group = ["series_id", "level"]
    base = levels(rows, m, limit)
    season = F.pmod(F.col("t") - 1, F.lit(m))
    frame = base.withColumn("p", season.cast("int")).withColumn("e", F.col("y") - F.avg("y").over(Window.partitionBy(*group, "p")))
    # The scale of a series does not matter to the statistic.
    frame = frame.withColumn("e", F.col("e") / F.greatest(F.max(F.abs("e")).over(Window.partitionBy(*group)), F.lit(1e-300)))
    width, reach = m - 1, ch_lags(longest, m)
    waves = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in harmonics(m)) + ")")
    lags = F.round(F.lit(m) * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int")
    frame = frame.withColumn("past", _past("e", max(reach, 1), group)).withColumn("lags", lags)
    wave = F.get(waves, F.col("p"))
    weighed = F.transform("past", lambda e, i: F.when(i < F.col("lags"), e * (1 - (i + 1) / (F.col("lags") + 1))).otherwise(0.0))
    frame = frame.select(*group, "t", "n", F.transform(wave, lambda h: h * F.col("e")).alias("u"), waves.alias("waves"), "p", weighed.alias("old"))
    earlier = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(
        F.transform("old", lambda e, i: e * F.get(F.get(F.col("waves"), F.pmod(F.col("p") - 1 - i, F.lit(m))), j)), F.lit(0.0), lambda s, x: s + x))
    frame = frame.select(*group, "t", "n", "u", earlier.alias("a"))
    along = Window.partitionBy(*group).orderBy("t")
    frame = frame.select(*group, "n", "u", "a", F.array(*[F.sum(F.get("u", F.lit(j))).over(along) for j in range(width)]).alias("f"))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    spread = ", ".join(f"sum(get(f, {i}) * get(f, {j}))" for i, j in pairs)
    cover = ", ".join(f"sum(get(u, {i}) * get(u, {j}) + get(a, {i}) * get(u, {j}) + get(u, {i}) * get(a, {j}))" for i, j in pairs)
    packed = frame.groupBy(*group).agg(F.first("n").alias("n"), F.expr(f"array({spread})").alias("spread"), F.expr(f"array({cover})").alias("cover"))

    def statistic(spread: np.ndarray, cover: np.ndarray, n: int) -> float | None:
        c = unpack(cover)
        values = np.linalg.svd(c, compute_uv=False)
        if n < 2 * m or values.min() <= np.finfo(float).eps * max(values.max(), 1.0):
            return None
        return float(np.trace(np.linalg.solve(c, unpack(spread))) / n)

    def solve(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield page[["series_id", "level", "n"]].assign(statistic=[statistic(s, c, n) for s, c, n in zip(page["spread"], page["cover"], page["n"])])

    return packed.mapInPandas(solve, "series_id string, level int, n long, statistic double")


def seasonal_orders(rows: DataFrame, m: int, limit: int, longest: int) -> DataFrame:
    """``(series_id, seasonal_d, ch)``: seasonal differences until the season is stable, and the statistic of the undifferenced series.

    A difference must leave two seasons of values, as a shorter rest is neither tested nor differenced.
    """
    stats = seasonal_stability(rows, m, limit, longest)
    stops = F.col("statistic").isNull() | (F.col("statistic") <= ch_critical(m)) | ((F.col("level") == 0) & (F.col("n") < 3 * m))
    return stats.groupBy("series_id").agg(_first_settled(stops, limit).alias("seasonal_d"), F.max(F.when(F.col("level") == 0, F.col("statistic"))).alias("ch"))

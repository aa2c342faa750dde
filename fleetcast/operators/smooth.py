"""Exponential smoothing: all configurations and parameter values of every series.

The relation is ``series x configuration``; within a batch of series the recursion runs
over time once, for all series and parameter values side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product as cartesian

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.config import HOLT_WINTERS, ForecastConfig
from fleetcast.functions.dates import add_periods
from fleetcast.functions.scalars import inverse_box_cox
from fleetcast.operators.calendars import training
from fleetcast.session import by_series, materialize

# Parameter grid, bounds, and the exponents tried for the transform.
ALPHAS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
BETAS = (0.01, 0.1, 0.3)
GAMMAS = (0.01, 0.1, 0.3)
PHIS = (0.9, 0.98)
BOUNDS = {"alpha": (0.2, 0.8), "beta": (0.0001, 0.9999), "gamma": (0.0001, 0.9999), "phi": (0.8, 0.995)}
STEPS = {"alpha": 0.05, "beta": 0.05, "gamma": 0.05, "phi": 0.04}
LAMBDAS = tuple(-1 + 0.25 * i for i in range(13))
FALLBACK_CONFIG = 1
SERIES_PER_BLOCK = 64


def configurations() -> list[dict]:
    """The grid of trend, damping, season and transform; damping needs a trend.

    Numbered in nested order, without the copies that differ only in unused damping.
    """
    out = []
    for trend, damped, season, transform in cartesian(("add", "mul", None), (True, False), ("add", "mul", None), (True, False)):
        if trend is None and not damped:
            continue
        out.append({"config_id": len(out), "trend": trend, "damped": damped and trend is not None,
                    "season": season, "box_cox": transform})
    return out


def parameter_grid(config: dict) -> np.ndarray:
    """Rows ``(alpha, beta, gamma, phi)``; unused parameters hold a neutral value."""
    return np.array(list(cartesian(
        ALPHAS, BETAS if config["trend"] else (0.0,), GAMMAS if config["season"] else (0.0,),
        PHIS if config["damped"] else (1.0,))))


def parameter_count(config: dict, m: int) -> int:
    """Smoothing parameters plus initial states, plus one for a transform exponent."""
    return (2 + (2 if config["trend"] else 0) + int(config["damped"])
            + (m + 1 if config["season"] else 0) + int(config["box_cox"]))


def with_configurations(series: DataFrame) -> DataFrame:
    """One row per series and configuration: the fixed grid is generated by each row."""
    entries = [F.struct(
        F.lit(c["config_id"]).alias("config_id"), F.lit(c["trend"]).cast("string").alias("trend"), F.lit(c["damped"]).alias("damped"),
        F.lit(c["season"]).cast("string").alias("season"), F.lit(c["box_cox"]).alias("box_cox")) for c in configurations()]
    return series.select("*", F.explode(F.array(*entries)).alias("c")).select("*", "c.*").drop("c")


def with_parameters(configured: DataFrame) -> DataFrame:
    """One row per series, configuration and point of its parameter grid."""
    def values(used: Column, grid: tuple[float, ...], neutral: float) -> Column:
        return F.when(used, F.array(*[F.lit(v) for v in grid])).otherwise(F.array(F.lit(neutral)))
    out = configured.withColumn("alpha", F.explode(F.array(*[F.lit(v) for v in ALPHAS])))
    out = out.withColumn("beta", F.explode(values(F.col("trend").isNotNull(), BETAS, 0.0)))
    out = out.withColumn("gamma", F.explode(values(F.col("season").isNotNull(), GAMMAS, 0.0)))
    return out.withColumn("phi", F.explode(values(F.col("damped"), PHIS, 1.0)))


# -- transform --------------------------------------------------------------------------

def _best_lambda() -> Column:
    """Exponent with the highest profile log-likelihood, as one aggregate over positive ``y``."""
    def likelihood(lam: float) -> str:
        z = "ln(y)" if lam == 0 else f"(pow(y, {lam}D) - 1) / {lam}D"
        return (f"struct(-count(y) / 2 * ln(nullif(var_pop(if(y > 0, {z}, NULL)), 0D)) + {lam - 1}D * sum(if(y > 0, ln(y), NULL)) AS llf, "
                f"{-lam}D AS tie, {lam}D AS lam)")
    entries = ", ".join(likelihood(lam) for lam in LAMBDAS)
    return F.expr(f"if(min(y) > 0, array_max(filter(array({entries}), e -> e.llf IS NOT NULL)).lam, NULL)")


def box_cox_lambda(product: DataFrame) -> DataFrame:
    """Exponent with the highest likelihood per series; NULL when a value is not positive."""
    return product.groupBy("series_id").agg(_best_lambda().alias("lam"))


def is_complete(config: ForecastConfig) -> Column:
    """Whether ``rows``, an ordered array of ``(ds, y)``, has a value for every period up to the cut."""
    gran, cut = config.granularity, F.lit(config.forecast_start)
    first, last = F.element_at("rows", 1)["ds"], F.element_at("rows", -1)["ds"]
    periods = F.months_between(cut, first) if gran == "month" else F.datediff(cut, first) / (7 if gran == "week" else 1)
    return (F.size("rows") == periods) & (add_periods(last, F.lit(1), gran) == cut) & ~F.exists("rows", lambda r: r["y"].isNull())


def packed_series(product: DataFrame, config: ForecastConfig) -> DataFrame:
    """``(series_id, ds, y, lam)`` with the complete training window as ordered arrays.

    The arrays are calendar-sized: one value per period of the window.
    """
    packed = by_series(training(product, config)).groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("rows"), _best_lambda().alias("lam"))
    return packed.where(is_complete(config)).select(
        "series_id", F.col("rows.ds").alias("ds"), F.col("rows.y").alias("y"), "lam")


# -- recursion --------------------------------------------------------------------------

def _transform(y, lam):
    with np.errstate(all="ignore"):
        return np.where(lam == 0, np.log(y), (np.power(y, lam) - 1) / np.where(lam == 0, 1, lam))


def _back(z, lam):
    with np.errstate(all="ignore"):
        return np.where(lam == 0, np.exp(z), np.power(z * lam + 1, 1 / np.where(lam == 0, 1, lam)))


def initial_states(z: np.ndarray, config: dict, m: int):
    """Level, trend and season from the first one or two cycles; NaN marks a failure."""
    head = z[:, :m]
    level = head.mean(axis=1)
    slope = np.zeros(len(z))
    with np.errstate(all="ignore"):
        if config["trend"] == "add":
            slope = (z[:, m:2 * m].mean(axis=1) - level) / m
        elif config["trend"] == "mul":
            slope = np.power(z[:, m:2 * m].mean(axis=1) / level, 1 / m)
        season = np.zeros((len(z), m))
        if config["season"] == "add":
            season = head - level[:, None]
        elif config["season"] == "mul":
            season = head / level[:, None]
    if "mul" in (config["trend"], config["season"]):
        level = np.where(z.min(axis=1) > 0, level, np.nan)
    return level, slope, season


def run(z: np.ndarray, lam: np.ndarray | None, config: dict, m: int, params: np.ndarray, keep: bool = False, start: tuple | None = None) -> dict:
    """Smooth ``z`` (series x time) with every parameter row (series x candidates x 4).

    Errors are summed on the smoothed scale and, for a transform, on the original scale. ``start`` gives level, slope and season of each
    candidate, and ``z`` and ``lam`` may then differ by candidate too (series x candidates x time).
    """
    n_series, n_par = params.shape[0], params.shape[1]
    a, b, g, phi = (params[:, :, i] for i in range(4))
    if start is None:
        level, slope, season = initial_states(z, config, m)
        l = np.repeat(level[:, None], n_par, axis=1)
        tr = np.repeat(slope[:, None], n_par, axis=1)
        s = np.repeat(season[:, None, :], n_par, axis=1)
    else:
        l, tr, s = (v.copy() for v in start)
        level, slope = l[:, 0].copy(), tr[:, 0].copy()
    sse, sse_raw = np.zeros((n_series, n_par)), np.zeros((n_series, n_par))
    fits = []
    lam2 = None if lam is None else lam if lam.ndim == 2 else lam[:, None]
    with np.errstate(all="ignore"):
        for t in range(z.shape[-1]):
            y, pos = z[:, t, None] if z.ndim == 2 else z[:, :, t], t % m
            if config["trend"] == "add":
                q = l + phi * tr
            elif config["trend"] == "mul":
                damped_tr = np.power(tr, phi)
                q = l * damped_tr
            else:
                q = l
            head = s[:, :, pos]
            if config["season"] == "add":
                f, base = q + head, y - head
            elif config["season"] == "mul":
                f, base = q * head, y / head
            else:
                f, base = q, y
            sse += (y - f) ** 2
            if lam is not None:
                shown = _back(f, lam2)
                sse_raw += (_back(y, lam2) - shown) ** 2
            else:
                shown = f
            if keep:
                fits.append(shown[:, 0])
            new = a * base + (1 - a) * q
            if config["trend"] == "add":
                tr = b * (new - l) + (1 - b) * phi * tr
            elif config["trend"] == "mul":
                tr = b * new / l + (1 - b) * damped_tr
            if config["season"] == "add":
                s[:, :, pos] = g * (y - q) + (1 - g) * head
            elif config["season"] == "mul":
                s[:, :, pos] = g * y / q + (1 - g) * head
            l = new
    if lam is None:
        sse_raw = sse
    out = {"sse": np.where(np.isfinite(sse), sse, np.inf), "sse_raw": np.where(np.isfinite(sse_raw), sse_raw, np.inf)}
    if keep:
        nxt = z.shape[-1] % m
        out |= {"fit": np.stack(fits, axis=1), "level": l[:, 0], "slope": tr[:, 0],
                "season": np.concatenate([s[:, 0, nxt:], s[:, 0, :nxt]], axis=1),
                "level0": level, "slope0": slope}
    return out


def _zoom(best: np.ndarray, config: dict, shrink: float) -> np.ndarray:
    """Neighbors of each series' best parameters, inside the bounds."""
    used = {"alpha": True, "beta": bool(config["trend"]), "gamma": bool(config["season"]), "phi": config["damped"]}
    moves = np.array(list(cartesian(*[(-STEPS[n] * shrink, 0.0, STEPS[n] * shrink) if u else (0.0,) for n, u in used.items()])))
    around = best[:, None, :] + moves[None, :, :]
    for i, (n, u) in enumerate(used.items()):
        if u:
            around[:, :, i] = np.clip(around[:, :, i], *BOUNDS[n])
    return around


START_ROUNDS = 12  # rounds of the pattern search for start values
STEP_SHRINK = 0.5


class Search:
    """Pattern search over smoothing parameters, start values and exponent, for all series of a block at once.

    A point is ``alpha, beta, gamma, phi, level, slope, season (m values), exponent``. In a round every coordinate is moved both ways; a series
    goes to the best of these points and of the point with all gains together. Coordinates without a gain get smaller steps.
    The squared error on the original scale never rises.
    """

    def __init__(self, y: np.ndarray, lam: np.ndarray | None, config: dict, m: int, best: np.ndarray):
        self.y, self.config, self.m, self.box_cox = y, config, m, lam is not None
        z = y if lam is None else _transform(y, lam[:, None])
        level, slope, season = initial_states(z, config, m)
        exponent = np.zeros(len(y)) if lam is None else lam
        self.point = np.column_stack([best, level, slope, season, exponent])
        spread = np.maximum(np.nan_to_num(z.std(axis=1)), 1e-12)[:, None]
        ones = np.ones_like(spread)
        additive = config["season"] == "add"
        self.steps = np.hstack([
            ones * [[STEPS[n] for n in ("alpha", "beta", "gamma", "phi")]], 0.2 * spread, 0.2 * spread / m if config["trend"] == "add" else 0.01 * ones,
            np.repeat(0.2 * spread if additive else 0.05 * ones, m, axis=1), 0.125 * ones])
        self.free = np.array([True, bool(config["trend"]), bool(config["season"]), config["damped"], True, bool(config["trend"]),
                              *[bool(config["season"])] * m, self.box_cox])
        self.loss = self.losses(self.point[:, None, :])[:, 0]

    def starts(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return points[:, :, 4], points[:, :, 5], points[:, :, 6:6 + self.m]

    def losses(self, points: np.ndarray) -> np.ndarray:
        """Squared error on the original scale of each point (series x points)."""
        lam = points[:, :, -1] if self.box_cox else None
        z = _transform(self.y[:, None, :], lam[:, :, None]) if self.box_cox else self.y
        return run(z, lam, self.config, self.m, points[:, :, :4], start=self.starts(points))["sse_raw"]

    def bounded(self, points: np.ndarray) -> np.ndarray:
        for i, n in enumerate(("alpha", "beta", "gamma", "phi")):
            if self.free[i]:
                points[:, :, i] = np.clip(points[:, :, i], *BOUNDS[n])
        if self.box_cox:
            points[:, :, -1] = np.clip(points[:, :, -1], LAMBDAS[0], LAMBDAS[-1])
        return points

    def rescaled(self, point: np.ndarray, exponent: np.ndarray) -> np.ndarray:
        """The point with another exponent, its start values carried to the new scale."""
        old = point[:, -1]
        carry = lambda v: _transform(_back(v, old if v.ndim == 1 else old[:, None]), exponent if v.ndim == 1 else exponent[:, None])
        level, slope, season = point[:, 4], point[:, 5], point[:, 6:6 + self.m]
        with np.errstate(all="ignore"):
            new = carry(level)
            add = self.config["trend"] == "add"
            tr = carry(level + slope) - new if add else carry(level * slope) / new if self.config["trend"] else slope
            add = self.config["season"] == "add"
            s = carry(level[:, None] + season) - new[:, None] if add else carry(level[:, None] * season) / new[:, None] if self.config["season"] else season
        return np.column_stack([point[:, :4], new, tr, s, exponent])

    def round(self) -> None:
        at, where = np.arange(len(self.y)), np.flatnonzero(self.free)
        moved = []
        for i in where:
            for sign in (1.0, -1.0):
                if i == len(self.free) - 1:
                    moved.append(self.rescaled(self.point, np.clip(self.point[:, -1] + sign * self.steps[:, -1], LAMBDAS[0], LAMBDAS[-1])))
                else:
                    new = self.point.copy()
                    new[:, i] += sign * self.steps[:, i]
                    moved.append(new)
        points = self.bounded(np.stack(moved, axis=1))
        loss = self.losses(points)
        gains = loss < self.loss[:, None]
        pairs = loss.reshape(len(at), -1, 2)
        side = pairs.argmin(axis=2)
        gained = gains.reshape(len(at), -1, 2).any(axis=2)
        # all gains but that of the exponent at once, whole and by half
        shift = np.zeros_like(self.point)
        for j, i in enumerate(where):
            if i < len(self.free) - 1:
                shift[:, i] = np.where(gained[:, j], np.where(side[:, j] == 0, 1.0, -1.0) * self.steps[:, i], 0.0)
        joint = self.bounded(np.stack([self.point + shift, self.point + shift / 2, self.point + shift / 4], axis=1))
        points, loss = np.concatenate([points, joint], axis=1), np.concatenate([loss, self.losses(joint)], axis=1)
        best = loss.argmin(axis=1)
        better = loss[at, best] < self.loss
        self.point = np.where(better[:, None], points[at, best], self.point)
        self.loss = np.where(better, loss[at, best], self.loss)
        self.steps[:, where] = np.where(gained, self.steps[:, where], self.steps[:, where] * STEP_SHRINK)


FIT_SCHEMA = ("series_id string, config_id int, alpha double, beta double, gamma double, phi double, lam double, "
              "sse double, n long, k long, aic double, level0 double, slope0 double, season0 array<double>")


def fit_configurations(packed: DataFrame, config: ForecastConfig, zoom_rounds: int = 3, start_rounds: int | None = None) -> DataFrame:
    """Best parameters and AIC per series and configuration; failures have no row.

    Parameters come from a grid, refined in ``zoom_rounds``; then ``start_rounds`` of a pattern search also fit start values and exponent.
    Without such rounds the start values are the usual ones of the first cycles. By default there are ``START_ROUNDS``, and none on the bare grid.
    """
    start_rounds = (START_ROUNDS if zoom_rounds else 0) if start_rounds is None else start_rounds
    m = config.season_length
    grid = configurations()

    def fit_one(c: dict, y: np.ndarray, lam: np.ndarray):
        lam = lam if c["box_cox"] else None
        z = y if lam is None else _transform(y, lam[:, None])
        params = np.repeat(parameter_grid(c)[None, :, :], len(y), axis=0)
        at = np.arange(len(y))
        res = run(z, lam, c, m, params)
        i = res["sse"].argmin(axis=1)
        best, sse, raw = params[at, i], res["sse"][at, i], res["sse_raw"][at, i]
        for r in range(zoom_rounds):
            params = _zoom(best, c, 0.5 ** r)
            res = run(z, lam, c, m, params)
            i = res["sse"].argmin(axis=1)
            better = res["sse"][at, i] < sse
            best = np.where(better[:, None], params[at, i], best)
            raw = np.where(better, res["sse_raw"][at, i], raw)
            sse = np.where(better, res["sse"][at, i], sse)
        found = Search(y, lam, c, m, best)
        for _ in range(start_rounds):
            found.round()
        kept = found.loss <= raw  # not so where the start failed
        return np.where(kept[:, None], found.point, np.nan), np.where(kept, found.loss, raw), best

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for n, same in page.groupby(page["y"].map(len)):
                for start in range(0, len(same), SERIES_PER_BLOCK):
                    block = same.iloc[start:start + SERIES_PER_BLOCK]
                    y = np.stack(block["y"].to_numpy()).astype(float)
                    lam = block["lam"].to_numpy(dtype=float)
                    for c in grid:
                        needs_cycles = c["trend"] is not None or c["season"] is not None
                        if needs_cycles and n < 2 * m:
                            continue
                        point, sse, grid_best = fit_one(c, y, lam)
                        best = np.where(np.isnan(point[:, :4]), grid_best, point[:, :4])
                        exponent = np.where(np.isnan(point[:, -1]), lam, point[:, -1])
                        k = parameter_count(c, m)
                        with np.errstate(all="ignore"):
                            aic = n * np.log(sse / n) + 2 * k
                        out = pd.DataFrame({
                            "series_id": block["series_id"].to_numpy(), "config_id": c["config_id"],
                            "alpha": best[:, 0], "beta": best[:, 1], "gamma": best[:, 2], "phi": best[:, 3],
                            "lam": exponent if c["box_cox"] else None, "sse": sse, "n": n, "k": k, "aic": aic,
                            "level0": point[:, 4], "slope0": point[:, 5], "season0": list(point[:, 6:6 + m])})
                        yield out[np.isfinite(out["aic"].to_numpy(dtype=float))]

    return packed.select("series_id", "y", "lam").mapInPandas(batches, FIT_SCHEMA)


def ranked(fits: DataFrame) -> DataFrame:
    """All configurations of a series by AIC; the first of equals wins."""
    order = Window.partitionBy("series_id").orderBy("aic", "config_id")
    return fits.withColumn("place", F.row_number().over(order).cast("long"))


def chosen(packed: DataFrame, fits: DataFrame) -> DataFrame:
    """The configuration with the least AIC per series, or the fixed fallback."""
    best = fits.groupBy("series_id").agg(F.min_by(F.struct(
        "config_id", "alpha", "beta", "gamma", "phi", "lam", "sse", "aic", "level0", "slope0", "season0"), F.struct("aic", "config_id")).alias("b"))
    none = F.struct(F.lit(FALLBACK_CONFIG).alias("config_id"), F.lit(ALPHAS[0]).alias("alpha"), F.lit(BETAS[0]).alias("beta"),
                    F.lit(GAMMAS[0]).alias("gamma"), F.lit(PHIS[0]).alias("phi"), F.lit(None).cast("double").alias("lam"),
                    *[F.lit(None).cast("double").alias(c) for c in ("sse", "aic", "level0", "slope0")], F.lit(None).cast("array<double>").alias("season0"))
    return packed.drop("lam").join(best, "series_id", "left").withColumn("b", F.coalesce("b", none)).select("series_id", "ds", "y", "b.*")


STATE_SCHEMA = ("series_id string, config_id int, trend string, damped boolean, season string, box_cox boolean, alpha double, "
                "beta double, gamma double, phi double, lam double, sse double, aic double, level0 double, slope0 double, "
                "level double, slope double, seasonal array<double>, ds array<date>, fit array<double>")


def final_states(winners: DataFrame, config: ForecastConfig) -> DataFrame:
    """Final and initial states and the fitted values of each series' winner."""
    m = config.season_length
    grid = configurations()

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for (cid, _), same in page.groupby(["config_id", page["y"].map(len)]):
                c = grid[int(cid)]
                y = np.stack(same["y"].to_numpy()).astype(float)
                lam = same["lam"].to_numpy(dtype=float) if c["box_cox"] else None
                z = y if lam is None else _transform(y, lam[:, None])
                params = same[["alpha", "beta", "gamma", "phi"]].to_numpy(dtype=float)[:, None, :]
                usual = initial_states(z, c, m)
                known = ~same["level0"].isna().to_numpy()
                given = [np.where(known, same[x].to_numpy(dtype=float), u) for x, u in zip(("level0", "slope0"), usual)]
                season = np.stack([np.asarray(v, dtype=float) if k else u for v, k, u in zip(same["season0"], known, usual[2])])
                res = run(z, lam, c, m, params, keep=True, start=(given[0][:, None], given[1][:, None], season[:, None, :]))
                yield pd.DataFrame({
                    "series_id": same["series_id"].to_numpy(), "config_id": cid, "trend": c["trend"], "damped": c["damped"],
                    "season": c["season"], "box_cox": c["box_cox"],
                    **{p: same[p].to_numpy() for p in ("alpha", "beta", "gamma", "phi", "lam", "sse", "aic")},
                    "level0": res["level0"], "slope0": res["slope0"], "level": res["level"], "slope": res["slope"],
                    "seasonal": list(res["season"]), "ds": same["ds"].to_numpy(), "fit": list(res["fit"])})

    return winners.mapInPandas(batches, STATE_SCHEMA)


def h_step(states: DataFrame, config: ForecastConfig) -> DataFrame:
    """Forecast of every horizon step from the final states, as column arithmetic."""
    m = config.season_length
    steps = states.select("*", F.explode(F.sequence(F.lit(1), F.lit(config.horizon))).alias("h"))
    damping = F.aggregate(F.sequence(F.lit(1), F.col("h")), F.lit(0.0), lambda a, i: a + F.pow(F.col("phi"), i))
    base = (
        F.when(F.col("trend") == "add", F.col("level") + damping * F.col("slope"))
        .when(F.col("trend") == "mul", F.col("level") * F.pow(F.col("slope"), damping))
        .otherwise(F.col("level"))
    )
    cycle = F.get("seasonal", (F.col("h") - 1) % m)
    value = F.when(F.col("season") == "add", base + cycle).when(F.col("season") == "mul", base * cycle).otherwise(base)
    value = F.when(F.col("box_cox"), inverse_box_cox(value, F.col("lam"))).otherwise(value)
    last = F.element_at("ds", -1)
    return steps.select(
        "series_id", add_periods(last, F.col("h"), config.granularity).alias("ds"),
        F.lit(HOLT_WINTERS).alias("method"), F.lit("pred").alias("kind"), value.alias("yhat"))


def fitted(states: DataFrame) -> DataFrame:
    return states.select("series_id", F.explode(F.arrays_zip("ds", "fit")).alias("p")).select(
        "series_id", F.col("p.ds").alias("ds"), F.lit(HOLT_WINTERS).alias("method"), F.lit("fit").alias("kind"), F.col("p.fit").alias("yhat"))


def parameter_table(states: DataFrame, m: int) -> DataFrame:
    """Long table of smoothing parameters, initial states, flags and criteria."""
    # The names of the report's rows. Forecasts carry no correction of bias, and a transform is used exactly where it is chosen.
    numbers = [("smoothing level alpha", "alpha"), ("smoothing trend beta", "beta"), ("damping trend phi", "phi"),
               ("smoothing seasonal gamma", "gamma"), ("initial level l_0", "level0"), ("initial trend t_0", "slope0"),
               ("lambda", "lam"), ("SSE", "sse"), ("AIC", "aic")]
    texts = [("boxcox_opti", F.col("box_cox")), ("remove_bias_opti", F.lit(False)), ("Trend", F.col("trend")), ("Damped", F.col("damped")), ("Saison", F.col("season")),
             ("saisonale Periode", F.lit(m)), ("boxcox", F.col("box_cox"))]
    cells = [F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), F.lit(None).cast("string").alias("text")) for n, c in numbers]
    cells += [F.struct(F.lit(n).alias("name"), F.lit(None).cast("double").alias("value"), F.coalesce(c.cast("string"), F.lit("None")).alias("text"))
              for n, c in texts]
    return states.select("series_id", F.lit(HOLT_WINTERS).alias("method"), F.explode(F.array(*cells)).alias("p")).select(
        "series_id", "method", "p.*")


def holt_winters(product: DataFrame, config: ForecastConfig, zoom_rounds: int = 3, start_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(forecast and fit, parameters)`` of the best configuration of every series."""
    packed = packed_series(product, config)
    # One row per series, read by forecast, fit and report: the search runs once.
    states = materialize(final_states(chosen(packed, fit_configurations(packed, config, zoom_rounds, start_rounds)), config), "smoothing-states")
    return h_step(states, config).unionByName(fitted(states)), parameter_table(states, config.season_length)


# -- one given configuration ------------------------------------------------------------

def smooth_additive(packed: DataFrame, m: int, alpha: float, beta: float, gamma: float, phi: float = 1.0) -> DataFrame:
    """Additive trend and season with given parameters, as a fold inside Catalyst.

    The season is a ring: the head is used and the new value is appended.
    """
    y = F.col("y")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / m
    first, second = F.slice(y, 1, m), F.slice(y, m + 1, m)
    seeded = packed.where(F.size("y") >= 2 * m).withColumn("l0", mean(first)).withColumn("b0", (mean(second) - F.col("l0")) / m)
    start = F.struct(
        F.col("l0").alias("l"), F.col("b0").alias("b"), F.transform(first, lambda v: v - F.col("l0")).alias("s"),
        F.lit(0.0).alias("sse"), F.array().cast("array<double>").alias("fit"))

    def move(st, v):
        q = st["l"] + phi * st["b"]
        head = F.element_at(st["s"], 1)
        level = alpha * (v - head) + (1 - alpha) * q
        return F.struct(
            level.alias("l"), (beta * (level - st["l"]) + (1 - beta) * phi * st["b"]).alias("b"),
            F.concat(F.slice(st["s"], 2, m - 1), F.array(gamma * (v - q) + (1 - gamma) * head)).alias("s"),
            (st["sse"] + F.pow(v - q - head, F.lit(2.0))).alias("sse"), F.concat(st["fit"], F.array(q + head)).alias("fit"))

    return seeded.select("series_id", "ds", F.aggregate(y, start, move).alias("st")).select(
        "series_id", "ds", F.col("st.l").alias("level"), F.col("st.b").alias("slope"), F.col("st.s").alias("seasonal"),
        F.col("st.sse").alias("sse"), F.col("st.fit").alias("fit"))

"""Linear methods for every series: least squares, ridge, lasso, elastic net.

Spark builds the moments (one shuffle), a batch solver turns each series' moments into
scaled coefficients, and everything after that is column arithmetic again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetcast.config import ELASTIC_NET, LASSO, MLR, RIDGE, ForecastConfig
from fleetcast.functions.scalars import zero_normalized
from fleetcast.operators import solvers
from fleetcast.operators.calendars import horizon_dates, training
from fleetcast.operators.gram import design, fold_moments, moments, scale_aggregates, scale_arrays, scaled
from fleetcast.session import by_series

# Penalty grid sizes and mix ratios.
RIDGE_ALPHAS = 8000
LASSO_ALPHAS = 5000
L1_RATIOS = (0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)

LINEAR = (MLR, RIDGE, LASSO, ELASTIC_NET)

MODEL_SCHEMA = ("series_id string, method string, coef array<double>, intercept double, alpha double, "
                "l1_ratio double, cv_score double, y_mean double, mean array<double>, scale array<double>")


def alpha_values(size: int) -> np.ndarray:
    return 10 ** np.linspace(10, -2, size) * 0.5


def _solve(packed: DataFrame, method: str, config: ForecastConfig) -> DataFrame:
    if method not in LINEAR:
        raise ValueError(f"{method} is not a linear method")
    k, forward = config.cv_folds, config.walk_forward
    l_alphas, r_alphas = alpha_values(LASSO_ALPHAS), alpha_values(RIDGE_ALPHAS)

    def one(folds: list[np.ndarray]):
        if method == MLR:
            b, b0 = solvers.least_squares(sum(folds))
            return b, b0, None, None, None
        if method == RIDGE:
            b, b0, alpha, score = solvers.ridge_cv(folds, r_alphas, k, forward)
            return b, b0, alpha, None, score
        ratios = (1.0,) if method == LASSO else L1_RATIOS
        b, b0, alpha, ratio, score = solvers.elastic_cv(folds, l_alphas, ratios, k, forward)
        return b, b0, alpha, (None if method == LASSO else ratio), score

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            solved = [one([solvers.unpack(f) for f in folds]) for folds in page["folds"]]
            out = page[["series_id", "y_mean", "mean", "scale"]].copy()
            out["method"] = method
            for i, name in enumerate(("coef", "intercept", "alpha", "l1_ratio", "cv_score")):
                out[name] = [s[i] for s in solved]
            yield out[["series_id", "method", "coef", "intercept", "alpha", "l1_ratio", "cv_score", "y_mean", "mean", "scale"]]

    return packed.mapInPandas(batches, MODEL_SCHEMA)


def fit_linear(product: DataFrame, drivers: DataFrame, config: ForecastConfig, method: str) -> DataFrame:
    """One model row per series, on the scaled drivers, with what is needed to unscale it."""
    packed, _ = fold_moments(product, drivers, config)
    return _solve(packed, method, config)


def unscaled(models: DataFrame) -> DataFrame:
    """Coefficients and intercept on the original scale of the drivers."""
    coef = F.zip_with("coef", "scale", lambda b, s: b / s)
    shift = F.aggregate(F.zip_with("raw_coef", "mean", lambda b, m: b * m), F.lit(0.0), lambda a, x: a + x)
    return models.withColumn("raw_coef", coef).withColumn(
        "raw_intercept", F.col("intercept") + F.col("y_mean") - shift)


def parameters(models: DataFrame, names: tuple[str, ...], scaled_coefficients: bool = False) -> DataFrame:
    """Long parameter table: one row per driver, the intercept, the penalty and the mix."""
    m = unscaled(models)
    coef = F.col("coef" if scaled_coefficients else "raw_coef")
    intercept = F.col("intercept") + F.col("y_mean") if scaled_coefficients else F.col("raw_intercept")
    entries = [F.struct(F.lit(n).alias("name"), F.get(coef, F.lit(i)).alias("value")) for i, n in enumerate(names)]
    entries += [
        F.struct(F.lit("Intercept").alias("name"), intercept.alias("value")),
        F.struct(F.lit("Regularization Strength Alpha").alias("name"), F.col("alpha").alias("value")),
        F.struct(F.lit("L1 Ratio").alias("name"), F.col("l1_ratio").alias("value")),
    ]
    return m.select("series_id", "method", F.explode(F.array(*entries)).alias("p")).select(
        "series_id", "method", "p.name", zero_normalized(F.col("p.value")).alias("value")).where("value IS NOT NULL")


def scoring_rows(product: DataFrame, drivers: DataFrame, config: ForecastConfig) -> tuple[DataFrame, tuple[str, ...]]:
    """Driver values for every training row and every horizon date of each series."""
    known = training(product, config).select("series_id", "ds", F.lit("fit").alias("kind"))
    future = horizon_dates(product, config).select("series_id", "ds", F.lit("pred").alias("kind"))
    return design(known.unionByName(future), drivers, config)


def score(models: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``(series_id, ds, method, kind, yhat)`` from coefficients on the original scale."""
    m = unscaled(models).select("series_id", "method", "raw_coef", "raw_intercept")
    total = F.col("raw_intercept")
    for i, n in enumerate(names):
        total = total + F.get("raw_coef", F.lit(i)) * F.col(f"`{n}`")
    return rows.join(m, "series_id").select("series_id", "ds", "method", "kind", total.alias("yhat"))


def contributions(models: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """What each driver adds to the forecast of each period, plus the intercept."""
    m = unscaled(models).select("series_id", "method", "raw_coef", "raw_intercept")
    parts = [F.struct(F.lit(n).alias("name"), (F.get("raw_coef", F.lit(i)) * F.col(f"`{n}`")).alias("value"))
             for i, n in enumerate(names)]
    parts.append(F.struct(F.lit("Intercept").alias("name"), F.col("raw_intercept").alias("value")))
    return rows.join(m, "series_id").select(
        "series_id", "ds", "method", "kind", F.explode(F.array(*parts)).alias("p")
    ).select("series_id", "ds", "method", "kind", "p.name", "p.value")


def forecast_linear(product: DataFrame, drivers: DataFrame, config: ForecastConfig, method: str) -> DataFrame:
    models = fit_linear(product, drivers, config, method)
    rows, names = scoring_rows(product, drivers, config)
    return score(models, rows, names)


STATS_SCHEMA = ("series_id string, name string, value double, std_err double, t_value double, p_value double, "
                "r2 double, sigma2 double, n long")


def least_squares_stats(product: DataFrame, drivers: DataFrame, config: ForecastConfig,
                        scaled_coefficients: bool = False) -> DataFrame:
    """Least squares with standard errors, t and p values, and the share of explained variance."""
    rows, names = design(product, drivers, config)
    frame = scaled(by_series(training(rows, config)), names)
    k = len(names)
    values = [f"_z{i}" for i in range(k)] + ["_y"]
    sums = frame.groupBy("series_id").agg(moments(values).alias("m"), *scale_aggregates(k))
    packed = sums.select("series_id", "m", *scale_arrays(k))

    def one(page: pd.Series) -> pd.DataFrame:
        m = solvers.unpack(page["m"])
        n, dof = m[0, 0], m[0, 0] - k - 1
        # Back to the requested scale by a linear map of (intercept, coefficients).
        back = np.eye(k + 1)
        if not scaled_coefficients:
            s, mu = np.asarray(page["scale"]), np.asarray(page["mean"])
            back[1:, 1:] = np.diag(1 / s)
            back[0, 1:] = -mu / s
        xtx = m[:-1, :-1]
        inv = np.linalg.pinv(xtx, rcond=1e-12, hermitian=True)
        beta = inv @ m[:-1, -1]
        sse = float(m[-1, -1] - beta @ m[:-1, -1])
        sigma2 = sse / dof if dof > 0 else np.nan
        raw = back @ beta
        raw[0] += page["y_mean"]
        err = np.sqrt(np.maximum(np.diag(back @ inv @ back.T) * sigma2, 0))
        t = raw / err
        spread = m[-1, -1] - m[0, -1] ** 2 / n
        order = list(range(1, k + 1)) + [0]
        return pd.DataFrame({
            "series_id": page["series_id"], "name": [*names, "Intercept"], "value": raw[order], "std_err": err[order],
            "t_value": t[order], "p_value": solvers.t_two_sided(t, dof)[order] if dof > 0 else np.nan,
            "r2": 1 - sse / spread, "sigma2": sigma2, "n": int(n)})

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            if len(page):
                yield pd.concat([one(r) for _, r in page.iterrows()], ignore_index=True)

    return packed.mapInPandas(batches, STATS_SCHEMA)

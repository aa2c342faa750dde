"""Seasonal ARIMA with and without drivers, by the two-stage regression of Hannan and Rissanen (1982).

Stage one fits a long autoregression from autocovariances; stage two regresses the
differenced series on its own lags, lags of the stage-one residuals, trend terms and
differenced drivers. Both stages are lag windows and grouped sums over all series at once.
One moment matrix per series serves every candidate order, trend and driver subset.

Differenced values are centered (an automatic intercept) and lags before the first value
are zero, so all candidates of a series are compared on the same rows.

Plain and seasonal lag polynomials are multiplied, as the model has it: the moment matrix also holds the lags ``i + m j`` of the
products, and the factors are found by Gauss-Newton steps on that matrix, for all candidates of a series at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product as cartesian

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetcast.config import SARIMA, SARIMAX, ForecastConfig
from fleetcast.operators import explore, roots, smooth
from fleetcast.operators.calendars import horizon_dates, training
from fleetcast.operators.gram import moments
from fleetcast.operators.solvers import squared_error, unpack
from fleetcast.session import by_series, materialize

# Search limits, trend terms and the out-of-sample length.
MAX_ORDER = 3
MAX_TOTAL_ORDER = 10
MAX_D = {SARIMA: 3, SARIMAX: 2}
TRENDS = {"None": (0, 0), "c": (1, 0), "t": (0, 1), "ct": (1, 1)}
OUT_OF_SAMPLE = 12
CRITERIA = ("aic", "aicc", "bic", "oob")

KEY = ["series_id", "d"]


# -- differencing orders ----------------------------------------------------------------

def _strength() -> Column:
    """Share of the season in what the trend leaves, between 0 and 1."""
    both = F.nullif(F.var_samp(F.col("seasonal") + F.col("rest")), F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.var_samp("rest") / both), F.lit(0.0))


def complete_rows(product: DataFrame, config: ForecastConfig) -> tuple[DataFrame, int]:
    """Training rows of the series with a value for every period, and the length of the longest window."""
    train = by_series(training(product, config).select("series_id", "ds", "y"))
    packed = train.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("rows"))
    rows = packed.where(smooth.is_complete(config)).select("series_id", F.inline("rows"))
    days = (config.forecast_start - config.train_start).days
    return rows, {"month": -(-days // 28), "week": -(-days // 7), "day": days}[config.granularity]


def differencing_orders(product: DataFrame, config: ForecastConfig, limit: int) -> DataFrame:
    """``(series_id, strength, ch, seasonal_d, d_adf, d_pp)`` of series with a complete window.

    ``seasonal_d`` comes from repeated Canova-Hansen tests, whose first statistic is ``ch``; ``strength`` describes the season. The plain
    orders are those of the undifferenced series.
    """
    m = config.season_length
    rows, longest = complete_rows(product, config)
    strength = explore.decompose(rows, m).groupBy("series_id").agg(_strength().alias("strength"))
    seasonal = roots.seasonal_orders(rows, m, limit, longest) if m > 1 else rows.groupBy("series_id").agg(F.lit(0).alias("seasonal_d"), F.lit(None).cast("double").alias("ch"))
    plain = roots.unit_root_orders(rows, limit, longest)
    return strength.join(seasonal, "series_id").join(plain, "series_id").select("series_id", "strength", "ch", "seasonal_d", "d_adf", "d_pp")


def orders(product: DataFrame, config: ForecastConfig, method: str) -> DataFrame:
    """``(series_id, d, seasonal_d)``: one row, or two where the unit-root tests disagree."""
    found = differencing_orders(product, config, MAX_D[method])
    return found.select("series_id", F.explode(F.array_distinct(F.array("d_adf", "d_pp"))).alias("d"), "seasonal_d")


def difference_weights(d: int, seasonal_d: int, m: int) -> dict[int, float]:
    """Lag weights of the product of plain and seasonal differences."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal_d):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(m - 1), -1.0])
    return {i: float(v) for i, v in enumerate(poly) if v}


# -- regression frame -------------------------------------------------------------------

def lag_set(m: int) -> tuple[list[int], list[int]]:
    plain = list(range(1, MAX_ORDER + 1))
    return plain, [m * i for i in range(1, MAX_ORDER + 1)] if m > MAX_ORDER else []


def product_terms(m: int) -> list[tuple[int, int, int]]:
    """``(place of the plain lag, place of the seasonal lag, lag)`` of the terms that the product of two lag polynomials adds."""
    plain, seasonal = lag_set(m)
    return [(i, j, a + b) for i, a in enumerate(plain) for j, b in enumerate(seasonal)]


class Factors:
    """Where the factors' parameters stand, and the feature weights that they stand for.

    Parameters are constant, drift, ``k`` drivers, then plain and seasonal lags of the values and of the errors. Features are the same, then the
    product terms of the values' lags and of the errors' lags.
    """

    def __init__(self, m: int, k: int):
        plain, seasonal = lag_set(m)
        self.lags, self.cross, self.first = plain + seasonal, product_terms(m), 2 + k
        self.n = 2 + k + 2 * len(self.lags)
        width = len(plain)
        #: for each product term: its feature, the two parameters and the sign of their product
        self.terms = [(self.n + part * len(self.cross) + x, self.first + part * len(self.lags) + i, self.first + part * len(self.lags) + width + j, sign)
                      for part, sign in ((0, -1.0), (1, 1.0)) for x, (i, j, _) in enumerate(self.cross)]
        self.n_features = self.n + 2 * len(self.cross)

    def weights(self, params: np.ndarray) -> np.ndarray:
        out = np.zeros((len(params), self.n_features))
        out[:, :self.n] = params
        for f, i, j, sign in self.terms:
            out[:, f] = sign * params[:, i] * params[:, j]
        return out

    def slopes(self, params: np.ndarray) -> np.ndarray:
        """Derivatives of the weights: candidates x features x parameters."""
        out = np.zeros((len(params), self.n_features, self.n))
        out[:, range(self.n), range(self.n)] = 1.0
        for f, i, j, sign in self.terms:
            out[:, f, i], out[:, f, j] = sign * params[:, j], sign * params[:, i]
        return out

    def all_lags(self) -> list[int]:
        """Lags in the order in which :meth:`split` gives their weights."""
        return [*self.lags, *[lag for *_, lag in self.cross]]

    def split(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the values' and of the errors' lags."""
        n, a, c = len(self.lags), self.first, len(self.cross)
        return (np.concatenate([weights[..., a:a + n], weights[..., self.n:self.n + c]], -1),
                np.concatenate([weights[..., a + n:a + 2 * n], weights[..., self.n + c:]], -1))


def _minus(now: Column, before: Column) -> Column:
    return F.zip_with(now, before, lambda a, b: a - b)


def _differenced(rows: DataFrame, m: int, limit: int, w) -> DataFrame:
    """Column ``v`` (target and drivers as one array) differenced as each series needs it.

    The windows share partitioning and order, so they run in one sorted pass.
    """
    v = F.col("v")
    out = rows
    for i in range(1, limit + 1 if m > 1 else 1):
        out = out.withColumn("v", F.when(F.col("seasonal_d") >= i, _minus(v, F.lag("v", m).over(w))).otherwise(v))
    for i in range(1, limit + 1):
        out = out.withColumn("v", F.when(F.col("d") >= i, _minus(v, F.lag("v", 1).over(w))).otherwise(v))
    return out


def levinson(gamma: Column) -> Column:
    """Autoregression coefficients from autocovariances (Levinson-Durbin), as a fold."""
    start = F.struct(F.array().cast("array<double>").alias("a"), F.element_at(gamma, 1).alias("v"))

    def grow(st, i):
        a, v = st["a"], st["v"]
        part = F.aggregate(F.zip_with(a, F.reverse(F.slice(gamma, 2, i - 1)), lambda x, g: x * g), F.lit(0.0), lambda s, x: s + x)
        k = F.when(v > 0, (F.get(gamma, i) - part) / v).otherwise(0.0)
        return F.struct(
            F.concat(F.zip_with(a, F.reverse(a), lambda x, r: x - k * r), F.array(k)).alias("a"), (v * (1 - k * k)).alias("v"))

    return F.aggregate(F.sequence(F.lit(1), F.size(gamma) - 1), start, grow, lambda st: st["a"])


def regression_frame(product: DataFrame, drivers: DataFrame | None, config: ForecastConfig, method: str, given: DataFrame | None = None) -> DataFrame:
    """Training and horizon rows with the differenced target ``w`` and its ``features``.

    ``given`` names the differences of each series ``(series_id, d, seasonal_d)`` in place of the tests. Training rows that differencing uses up
    come along as kind ``start``, with their level only.
    """
    m, names = config.season_length, config.drivers if drivers is not None else ()
    rows = training(product, config).select("series_id", "ds", "y", F.lit("fit").alias("kind")).unionByName(
        horizon_dates(product, config).select("series_id", "ds", F.lit(None).cast("double").alias("y"), F.lit("pred").alias("kind")))
    if names:
        rows = rows.join(drivers.select("ds", *names), "ds")
    rows = by_series(rows.join(orders(product, config, method) if given is None else given, "series_id"))
    w = Window.partitionBy(*KEY).orderBy("ds")
    whole = Window.partitionBy(*KEY)
    vector = rows.select(*KEY, "seasonal_d", "ds", "kind", "y", F.array("y", *names).alias("v"))
    diffed = _differenced(vector, m, MAX_D[method], w).withColumn("w0", F.get("v", F.lit(0)))
    diffed = diffed.withColumn("kind", F.when((F.col("kind") == "fit") & F.col("w0").isNull(), "start").otherwise(F.col("kind")))
    usable, starts = diffed.where("kind <> 'start'"), diffed.where("kind = 'start'")
    # Target and drivers are centered on the training rows.
    means = {f"_x{i}": F.avg(F.when(F.col("kind") == "fit", F.get("v", F.lit(i + 1)))).over(whole) for i in range(len(names))}
    framed = usable.withColumns({
        "w_mean": F.avg("w0").over(whole), "n": F.count("w0").over(whole), "rn": F.row_number().over(w), **means,
    }).withColumn("w", F.col("w0") - F.col("w_mean"))
    xs = [F.get("v", F.lit(i + 1)) - F.col(f"_x{i}") for i in range(len(names))]
    plain, seasonal = lag_set(m)
    lags = plain + seasonal
    across = [lag for *_, lag in product_terms(m)]
    long_ar = max(m + 2, 2 * MAX_ORDER + 2)

    def past(name: str) -> Column:
        """Earlier values, latest first."""
        reach = max(lags + across + [long_ar])
        return F.reverse(F.collect_list(name).over(w.rowsBetween(-reach, -1)))

    def at(values: str, lag: int) -> Column:
        return F.coalesce(F.get(values, F.lit(lag - 1)), F.lit(0.0))

    stage1 = framed.withColumn("past_w", past("w"))
    # Sums over the series stay on its rows: no aggregation is joined back. Only the last
    # training row turns them into coefficients.
    products = {f"_g{j}": F.sum(F.col("w") * (at("past_w", j) if j else F.col("w"))).over(whole) for j in range(long_ar + 1)}
    last = (F.col("kind") == "fit") & (F.col("rn") == F.col("n"))
    solved = F.when(last, levinson(F.array(*[F.col(c) for c in products])))
    fitted = stage1.withColumns(products).withColumn("ar", solved).drop(*products).withColumn("ar", F.max("ar").over(whole))
    predicted = F.aggregate(
        F.zip_with("ar", F.slice("past_w", 1, long_ar), lambda a, p: a * F.coalesce(p, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    stage2 = fitted.withColumn("e", F.col("w") - predicted).withColumn("past_e", past("e"))
    features = F.array(
        F.lit(1.0), F.col("rn") / F.col("n"), *xs, *[at("past_w", j) for j in lags], *[at("past_e", j) for j in lags],
        *[at("past_w", j) for j in across], *[at("past_e", j) for j in across])
    shown = stage2.select(*KEY, "seasonal_d", "ds", "kind", "y", "w", "w_mean", "n", "rn", "e", features.alias("features"))
    return shown.unionByName(starts.select(*KEY, "seasonal_d", "ds", "kind", "y"), allowMissingColumns=True)


def frame_moments(frame: DataFrame, n_features: int) -> DataFrame:
    """Moments of the training rows per series, apart for the last rows used by ``oob``."""
    values = [f"get(features, {i})" for i in range(1, n_features)] + ["w"]
    parts = (
        frame.where("kind = 'fit'").withColumn("tail", F.col("rn") > F.col("n") - OUT_OF_SAMPLE)
        .groupBy(*KEY, "seasonal_d", "tail").agg(moments(values).alias("m"))
    )
    return parts.groupBy(*KEY, "seasonal_d").agg(
        F.max(F.when(~F.col("tail"), F.col("m"))).alias("head"), F.max(F.when(F.col("tail"), F.col("m"))).alias("tail"))


# -- candidates -------------------------------------------------------------------------

def candidate_masks(m: int, k: int, subsets: bool) -> tuple[pd.DataFrame, np.ndarray]:
    """Order, trend and driver subset of every candidate, and which features it uses."""
    plain, seasonal = lag_set(m)
    rng = range(MAX_ORDER + 1)
    srng = rng if seasonal else range(1)
    driver_sets = list(range(2 ** k)) if subsets else [2 ** k - 1]
    info, masks = [], []
    for p, q, sp, sq in cartesian(rng, rng, srng, srng):
        if p + q + sp + sq > MAX_TOTAL_ORDER:
            continue
        ar = [j < p for j in range(len(plain))] + [j < sp for j in range(len(seasonal))]
        ma = [j < q for j in range(len(plain))] + [j < sq for j in range(len(seasonal))]
        for trend, (c, t) in TRENDS.items():
            for chosen in driver_sets:
                info.append((p, q, sp, sq, trend, chosen))
                masks.append([c, t] + [chosen >> i & 1 for i in range(k)] + ar + ma)
    return pd.DataFrame(info, columns=["p", "q", "sp", "sq", "trend", "driver_mask"]), np.array(masks, dtype=float)


def _masked_solve(a: np.ndarray, c: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Solutions of one system, or of one for each mask, in which the masked unknowns are zero."""
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-300))
    lhs = a / (scale[..., :, None] * scale[..., None, :]) * masks[:, :, None] * masks[:, None, :]
    lhs = lhs + (1 - masks + 1e-9)[:, :, None] * np.eye(masks.shape[1])
    return np.linalg.solve(lhs, (c / scale * masks)[:, :, None])[:, :, 0] / scale


def _masked_fit(mom: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Coefficients of every candidate without product terms; features outside its mask get zero."""
    return _masked_solve(mom[:-1, :-1], mom[:-1, -1], masks)


GAUSS_NEWTON = 60  # steps at most
SETTLED = 1e-10  # relative gain below which a candidate is done
AT_ONCE = 2048  # candidates solved together
STRETCH = 128  # candidates of a search between looks at the best


def product_fit(mom: np.ndarray, masks: np.ndarray, factors: Factors) -> np.ndarray:
    """Parameters of every candidate, from least squares without the products by Gauss-Newton steps that are halved until they gain."""
    n = factors.n
    a, c, total = mom[:-1, :-1], mom[:-1, -1], mom[-1, -1]
    inside = np.r_[0:n, -1]
    params = _masked_fit(mom[np.ix_(inside, inside)], masks)
    if not factors.terms:
        return params

    def error(p: np.ndarray) -> np.ndarray:
        w = factors.weights(p)
        return total - 2 * w @ c + ((w @ a) * w).sum(1)

    crossed = np.any([(masks[:, i] > 0) & (masks[:, j] > 0) for _, i, j, _ in factors.terms], axis=0)
    for start in range(0, len(masks), AT_ONCE):
        todo = start + np.flatnonzero(crossed[start:start + AT_ONCE])
        best = error(params[todo])
        # the products of a start that they make worse begin at smaller factors
        lags = np.arange(n) >= factors.first
        for _ in range(6):
            worse = ~np.isfinite(best) | (best > total)
            if not worse.any():
                break
            params[todo[worse]] = np.where(lags, params[todo[worse]] / 2, params[todo[worse]])
            best[worse] = error(params[todo[worse]])
        for _ in range(GAUSS_NEWTON):
            if not len(todo):
                break
            p, d = params[todo], factors.slopes(params[todo])
            ad = a @ d
            normal = np.swapaxes(d, 1, 2) @ ad
            gradient = np.einsum("cfp,cf->cp", d, c - factors.weights(p) @ a)
            step = _masked_solve(normal, gradient, masks[todo])
            gain, size = np.zeros(len(todo)), 1.0
            open_ = np.ones(len(todo), bool)
            for _ in range(12):
                trial = p[open_] + size * step[open_]
                e = error(trial)
                better = e < best[open_]
                at = np.flatnonzero(open_)[better]
                gain[at] = (best[at] - e[better]) / np.maximum(best[at], 1e-300)
                params[todo[at]], best[at] = trial[better], e[better]
                open_[at] = False
                if not open_.any():
                    break
                size /= 2
            going = gain > SETTLED
            todo, best = todo[going], best[going]
    return params


def _dies_out(poly: np.ndarray) -> np.ndarray:
    """Whether all roots of ``z^n - a1 z^(n-1) - ...`` are inside the unit circle."""
    n = poly.shape[1]
    companion = np.zeros((len(poly), n, n))
    companion[:, 0] = poly
    companion[:, range(1, n), range(n - 1)] = 1.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) < 1.0


def _stable(params: np.ndarray, m: int, k: int) -> np.ndarray:
    """Candidates whose autoregressive part dies out: a product does if its factors do."""
    plain, seasonal = lag_set(m)
    phi = params[:, 2 + k:2 + k + len(plain) + len(seasonal)]
    ok = _dies_out(phi[:, :len(plain)])
    return ok & _dies_out(phi[:, len(plain):]) if seasonal else ok


def parameter_counts(masks: np.ndarray, d: int, seasonal_d: int) -> np.ndarray:
    """Parameters with the variance and the automatic intercept of an undifferenced series."""
    return masks.sum(axis=1) + 1 + (1 if d + seasonal_d == 0 else 0)


def least_errors(total: np.ndarray, masks: np.ndarray, factors: Factors) -> np.ndarray:
    """Squared error of every candidate with free weights for its product terms: no product can be below it."""
    wide = np.hstack([masks, np.zeros((len(masks), len(factors.terms)))])
    for f, i, j, _ in factors.terms:
        wide[:, f] = masks[:, i] * masks[:, j]
    out = []
    for start in range(0, len(wide), AT_ONCE):
        free = _masked_fit(total, wide[start:start + AT_ONCE])
        out.append(total[-1, -1] - 2 * free @ total[:-1, -1] + ((free @ total[:-1, :-1]) * free).sum(1))
    return np.maximum(np.concatenate(out), 1e-300)


def evaluate(head: np.ndarray, tail: np.ndarray | None, d: int, seasonal_d: int, m: int, k: int, masks: np.ndarray, held_out: bool = True):
    """Parameters, squared error, parameter count, validity and, with ``held_out``, out-of-sample error of all candidates."""
    factors = Factors(m, k)
    total = head if tail is None else head + tail
    n = total[0, 0]
    params = product_fit(total, masks, factors)
    weights = factors.weights(params)
    # The constant is the first feature, so the intercept slot of the error form is zero.
    sse = squared_error(np.pad(total, ((1, 0), (1, 0))), weights, np.zeros(len(weights)))
    count = parameter_counts(masks, d, seasonal_d)
    ok = (n > 2 * count) & (sse > 0) & _stable(params, m, k)
    oob = np.full(len(params), np.nan)
    if held_out and tail is not None and head[0, 0] > 0:
        early = factors.weights(product_fit(head, masks, factors))
        oob = squared_error(np.pad(tail, ((1, 0), (1, 0))), early, np.zeros(len(early))) / tail[0, 0]
        oob = np.where(head[0, 0] > 2 * count, oob, np.nan)
    return params, sse, count, ok, oob, int(n)


def criterion_column(name: str) -> Column:
    """Selection criterion from squared error, rows and parameters."""
    sse, n, k = F.col("sse"), F.col("n"), F.col("k")
    fit = n * F.ln(sse / n)
    aic = fit + 2 * k
    return {
        "aic": aic, "bic": fit + k * F.ln(n),
        "aicc": F.when(n - k - 1 > 0, aic + 2 * k * (k + 1) / F.when(n - k - 1 > 0, n - k - 1)),
        "oob": F.col("oob"),
    }[name]


CANDIDATE_SCHEMA = ("series_id string, d int, seasonal_d int, p int, q int, sp int, sq int, trend string, driver_mask int, "
                    "sse double, n long, k long, oob double")


def _unpacked(row):
    return unpack(row["head"]) if row["head"] is not None else None, unpack(row["tail"]) if row["tail"] is not None else None


def _usable(head, tail):
    return (tail, None) if head is None else (head, tail)


def candidates(packed: DataFrame, m: int, k: int, subsets: bool = False) -> DataFrame:
    """Every valid candidate of every series as a relation with all criteria."""
    info, masks = candidate_masks(m, k, subsets)

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for row in page.to_dict("records"):
                head, tail = _usable(*_unpacked(row))
                _, sse, params, ok, oob, n = evaluate(head, tail, row["d"], row["seasonal_d"], m, k, masks)
                out = info.copy()
                out["series_id"], out["d"], out["seasonal_d"], out["n"] = row["series_id"], row["d"], row["seasonal_d"], n
                out["sse"], out["k"], out["oob"] = sse, params.astype(int), np.where(np.isnan(oob), None, oob)
                yield out[ok][["series_id", "d", "seasonal_d", "p", "q", "sp", "sq", "trend", "driver_mask", "sse", "n", "k", "oob"]]

    rows = packed.mapInPandas(batches, CANDIDATE_SCHEMA)
    return rows.select("*", *[criterion_column(c).alias(c) for c in CRITERIA[:3]])


MODEL_SCHEMA = ("series_id string, d int, seasonal_d int, p int, q int, sp int, sq int, trend string, driver_mask int, "
                "criterion double, sse double, n long, k long, coef array<double>, std_err array<double>, p_value array<double>, "
                "used array<boolean>, weights array<double>")


def search(packed: DataFrame, m: int, k: int, criterion: str = "aic", subsets: bool = False) -> DataFrame:
    """The candidate with the least criterion per series, with standard errors and p values."""
    info, masks = candidate_masks(m, k, subsets)

    def value(sse, n, params, oob):
        with np.errstate(all="ignore"):
            fit = n * np.log(sse / n)
            if criterion == "bic":
                return fit + params * np.log(n)
            if criterion == "aicc":
                return np.where(n - params - 1 > 0, fit + 2 * params + 2 * params * (params + 1) / (n - params - 1), np.inf)
            return oob if criterion == "oob" else fit + 2 * params

    factors = Factors(m, k)

    def every(row, head, tail):
        """All candidates, in stretches by the least that their criterion can be, until no other can be better."""
        d, seasonal_d = row["d"], row["seasonal_d"]
        if criterion == "oob":
            return np.arange(len(masks)), evaluate(head, tail, d, seasonal_d, m, k, masks)
        total = head if tail is None else head + tail
        bound = value(least_errors(total, masks, factors), total[0, 0], parameter_counts(masks, d, seasonal_d), None)
        order = np.argsort(np.where(np.isfinite(bound), bound, np.inf), kind="stable")
        found, least = [], np.inf
        for start in range(0, len(order), STRETCH):
            at = order[start:start + STRETCH]
            if found and bound[at[0]] - 1e-6 * abs(bound[at[0]]) > least:
                break
            got = evaluate(head, tail, d, seasonal_d, m, k, masks[at], held_out=False)
            crit = value(got[1], got[5], got[2], got[4])
            least = min(least, np.min(crit[got[3] & np.isfinite(crit)], initial=np.inf))
            found.append((at, got))
        at = np.concatenate([f[0] for f in found])
        back = np.argsort(at)  # in the order of the candidates, so that the first of equals wins
        return at[back], (*[np.concatenate([f[1][i] for f in found])[back] for i in range(5)], found[0][1][5])

    def one(row):
        head, tail = _usable(*_unpacked(row))
        which, (coef, sse, params, ok, oob, n) = every(row, head, tail)
        crit = value(sse, n, params, oob)
        crit = np.where(ok & np.isfinite(crit), crit, np.inf)
        if not np.isfinite(crit).any():
            return None
        i = int(np.argmin(crit))
        used = masks[which[i]] > 0
        total = head if tail is None else head + tail
        err, pv = np.full(len(used), np.nan), np.full(len(used), np.nan)
        slopes = factors.slopes(coef[i:i + 1])[0]
        sub = (slopes.T @ total[:-1, :-1] @ slopes)[np.ix_(used, used)]
        sigma2 = sse[i] / max(n - params[i], 1)
        err[used] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(sub, hermitian=True)) * sigma2, 0))
        with np.errstate(all="ignore"):
            z = np.abs(coef[i] / err)
        pv[used] = [math.erfc(v / math.sqrt(2)) for v in z[used]]
        shown = lambda a: [None if np.isnan(v) else float(v) for v in a]
        return {"series_id": row["series_id"], "d": row["d"], "seasonal_d": row["seasonal_d"], **info.iloc[which[i]].to_dict(),
                "criterion": crit[i], "sse": sse[i], "n": n, "k": int(params[i]), "coef": coef[i],
                "std_err": shown(err), "p_value": shown(pv), "used": used, "weights": factors.weights(coef[i:i + 1])[0]}

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            found = [r for r in (one(row) for row in page.to_dict("records")) if r is not None]
            if found:
                yield pd.DataFrame(found)

    models = packed.mapInPandas(batches, MODEL_SCHEMA)
    # Differencing variants have different numbers of rows: compare per row.
    per_row = F.col("criterion") if criterion == "oob" else F.col("criterion") / F.col("n")
    every = F.struct(*[c for c in models.columns if c != "series_id"])
    return models.groupBy("series_id").agg(F.min_by(every, F.struct(per_row, F.col("d"))).alias("b")).select("series_id", "b.*")


# -- forecast and report ----------------------------------------------------------------

def feature_names(names: tuple[str, ...], m: int) -> list[str]:
    """Parameters, then the product terms."""
    cross = [(i + 1, (j + 1) * m) for i, j, _ in product_terms(m)]
    return parameter_names(names, m) + [f"{part}.L{i}.S.L{j}" for part in ("ar", "ma") for i, j in cross]


def parameter_names(names: tuple[str, ...], m: int) -> list[str]:
    plain, seasonal = lag_set(m)
    return (["intercept", "drift", *names] + [f"ar.L{j}" for j in plain] + [f"ar.S.L{j}" for j in seasonal]
            + [f"ma.L{j}" for j in plain] + [f"ma.S.L{j}" for j in seasonal])


def parameter_table(models: DataFrame, names: tuple[str, ...], m: int, method: str) -> DataFrame:
    """Coefficients with standard error and p value, then orders, trend and criteria."""
    blank = F.lit(None).cast("double")
    cells = []
    for i, n in enumerate(parameter_names(names, m)):
        at = F.lit(i)
        cells.append(F.struct(
            F.lit(n).alias("name"), F.when(F.get("used", at), F.round(F.get("coef", at), 4)).alias("value"),
            F.lit(None).cast("string").alias("text"), F.round(F.get("std_err", at), 3).alias("std_err"),
            F.round(F.get("p_value", at), 3).alias("p_value")))
    fit = F.col("n") * F.ln(F.col("sse") / F.col("n"))
    texts = {"Order": F.format_string("(%d, %d, %d)", "p", "d", "q"),
             "Seasonal Order": F.format_string(f"(%d, %d, %d, {m})", "sp", "seasonal_d", "sq"), "Trend": F.col("trend")}
    numbers = {"AIC": fit + 2 * F.col("k"), "BIC": fit + F.col("k") * F.ln("n")}
    cells += [F.struct(F.lit(n).alias("name"), blank.alias("value"), t.alias("text"), blank.alias("std_err"), blank.alias("p_value"))
              for n, t in texts.items()]
    cells += [F.struct(F.lit(n).alias("name"), F.round(v, 3).alias("value"), F.lit(None).cast("string").alias("text"),
                       blank.alias("std_err"), blank.alias("p_value")) for n, v in numbers.items()]
    return models.select("series_id", F.lit(method).alias("method"), F.explode(F.array(*cells)).alias("p")).select(
        "series_id", "method", "p.*").where("value IS NOT NULL OR text IS NOT NULL")


def start_fit(y: np.ndarray, d: int, seasonal_d: int, m: int) -> list[float]:
    """Fit of the values that differencing uses up: each from the differences that its own past allows; nothing is known of the first, which is 0."""
    out = []
    for t in range(len(y)):
        seasons = min(seasonal_d, t // m)
        weights = difference_weights(min(d, t - m * seasons), seasons, m)
        out.append(float(-sum(c * y[t - j] for j, c in weights.items() if j)))
    return out


def ahead(w: np.ndarray, e: np.ndarray, y: np.ndarray, inputs: np.ndarray, phi: np.ndarray, theta: np.ndarray, lags: list[int],
          weights: dict[int, float], mean: float = 0.0) -> np.ndarray:
    """Levels after a past ``w, e, y`` of differences, errors and levels, given what enters the differences in each period and their mean.

    The recursion is linear, so the paths of parts of the past and of the inputs add up to the path of all.
    """
    reach = max(lags)
    w, e, y = (np.r_[np.zeros(n), np.asarray(v, dtype=float)] for n, v in ((reach, w), (reach, e), (max(weights), y)))
    for x in inputs:
        nxt = x + sum(phi[i] * w[-j] + theta[i] * e[-j] for i, j in enumerate(lags))
        w, e = np.r_[w, nxt], np.r_[e, 0.0]
        y = np.r_[y, nxt + mean - sum(c * y[-j] for j, c in weights.items() if j)]
    return y[len(y) - len(inputs):]


def paths(frame: DataFrame, models: DataFrame, config: ForecastConfig, names: tuple[str, ...] = ()) -> DataFrame:
    """``(series_id, ds, kind, yhat, parts)``: in-sample fit of every training row and forecast, with the part of each driver and the rest.

    The part of a driver is what its differenced values add: to a fit in its own period, to a forecast through lags and through the sums that
    undo the differences.
    """
    m, k = config.season_length, len(names)
    rows = frame.join(models.select(*KEY, "weights"), KEY)
    explained = F.aggregate(F.zip_with("weights", "features", lambda b, x: b * x), F.lit(0.0), lambda s, v: s + v)
    effects = F.transform(F.slice("features", 3, k), lambda x, i: x * F.get("weights", i + 2)) if k else F.array().cast("array<double>")
    # One calendar-sized row per series: its past, and its future trend and driver terms.
    starts = F.array_sort(F.collect_list(F.when(F.col("kind") == "start", F.struct("ds", "y"))))
    known = F.array_sort(F.collect_list(F.when(F.col("kind") == "fit", F.struct(
        "ds", "y", "w", "e", (F.col("y") - F.col("w") + explained).alias("fit"), effects.alias("effects")))))
    future = F.array_sort(F.collect_list(F.when(F.col("kind") == "pred", F.struct("ds", F.slice("features", 1, 2 + k).alias("x")))))
    packed = rows.groupBy(*KEY, "seasonal_d").agg(
        starts.alias("starts"), known.alias("known"), future.alias("future"), F.first("weights").alias("weights"), F.max("w_mean").alias("w_mean")
    ).select(*KEY, "seasonal_d", "weights", "w_mean", F.col("starts.y").alias("start_y"), *[F.col(f"known.{c}").alias(c) for c in ("y", "w", "e", "fit", "effects")],
             F.col("future.x").alias("x"), F.concat("starts.ds", "known.ds", "future.ds").alias("ds"))
    factors = Factors(m, k)
    lags = factors.all_lags()

    def one(row) -> tuple[list[str], list[float], list[list[float]]]:
        weights = np.asarray(row["weights"], dtype=float)
        phi, theta = factors.split(weights)
        d, seasonal_d = int(row["d"]), int(row["seasonal_d"])
        undo = difference_weights(d, seasonal_d, m)
        first = start_fit(np.asarray(row["start_y"], dtype=float), d, seasonal_d, m)
        x = np.array([list(v) for v in row["x"]], dtype=float).reshape(-1, 2 + k)
        inputs, none = x * weights[:2 + k], np.zeros(0)
        drivers = [ahead(none, none, none, inputs[:, 2 + i], phi, theta, lags, undo) for i in range(k)]
        levels = np.r_[np.asarray(row["start_y"], dtype=float), np.asarray(row["y"], dtype=float)]
        rest = ahead(row["w"], row["e"], levels, inputs[:, :2].sum(1), phi, theta, lags, undo, row["w_mean"])
        effects = [list(v) for v in row["effects"]]
        parts = [[0.0] * k + [f] for f in first] + [[*v, f - sum(v)] for v, f in zip(effects, row["fit"])] + [[*[p[t] for p in drivers], rest[t]] for t in range(len(x))]
        kinds = ["fit"] * (len(first) + len(effects)) + ["pred"] * len(x)
        return kinds, [sum(p) for p in parts], parts

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            done = [one(r) for r in page.to_dict("records")]
            yield pd.DataFrame({"series_id": page["series_id"], "ds": page["ds"], **{c: [x[i] for x in done] for i, c in enumerate(("kind", "yhat", "parts"))}})

    done = packed.mapInPandas(batches, "series_id string, ds array<date>, kind array<string>, yhat array<double>, parts array<array<double>>")
    return done.select("series_id", F.inline(F.arrays_zip("ds", "kind", "yhat", "parts")))


def forecast(frame: DataFrame, models: DataFrame, config: ForecastConfig, method: str, k: int) -> DataFrame:
    """Recursive forecast over the horizon and the in-sample fit of every training row."""
    names = config.drivers if k else ()
    return paths(frame, models, config, names).select("series_id", "ds", F.lit(method).alias("method"), "kind", "yhat")


def contributions(frame: DataFrame, models: DataFrame, config: ForecastConfig, names: tuple[str, ...]) -> DataFrame:
    """``(series_id, ds, method, kind, name, value)``; the parts of a date, with the rest named ``History``, sum to the forecast or fit."""
    labels = F.array(*[F.lit(n) for n in (*names, "History")])
    parts = paths(frame, models, config, names).select("series_id", "ds", F.lit(SARIMAX).alias("method"), "kind", F.explode(F.arrays_zip(labels.alias("name"), F.col("parts").alias("value"))).alias("p"))
    return parts.select("series_id", "ds", "method", "kind", "p.name", "p.value")


def arima(product: DataFrame, drivers: DataFrame | None, config: ForecastConfig, subsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(forecast and fit, parameters)`` of the best candidate of every series.

    With drivers this is the method with exogenous variables; ``subsets`` also searches
    all subsets of them.
    """
    method = SARIMA if drivers is None else SARIMAX
    names = config.drivers if drivers is not None else ()
    m, k = config.season_length, len(names)
    frame = regression_frame(product, drivers, config, method)
    found = search(frame_moments(frame, len(feature_names(names, m))), m, k, config.criterion, subsets)
    # One small row per series, read by the forecast and the report: the search runs once.
    models = materialize(found, "arima-models")
    return forecast(frame, models, config, method, k), parameter_table(models, names, m, method)


def driver_contributions(product: DataFrame, drivers: DataFrame, config: ForecastConfig) -> DataFrame:
    """Contributions of every driver to the fits and forecasts of the best candidate with exogenous variables."""
    frame = regression_frame(product, drivers, config, SARIMAX)
    names, m = config.drivers, config.season_length
    models = materialize(search(frame_moments(frame, len(feature_names(names, m))), m, len(names), config.criterion), "arima-models")
    return contributions(frame, models, config, names)


def given_order(product: DataFrame, config: ForecastConfig, d: int, seasonal_d: int, order: tuple[int, int, int, int], trend: str = "None") -> DataFrame:
    """``(series_id, n, sse, params)`` of one order ``(p, q, P, Q)`` for every complete series; ``params`` as named by :func:`parameter_names`."""
    m = config.season_length
    rows, _ = complete_rows(product, config)
    given = rows.select("series_id").distinct().select("series_id", F.lit(d).alias("d"), F.lit(seasonal_d).alias("seasonal_d"))
    packed = frame_moments(regression_frame(product, None, config, SARIMA, given), len(feature_names((), m)))
    info, masks = candidate_masks(m, 0, False)
    p, q, sp, sq = order
    mask = masks[((info.p == p) & (info.q == q) & (info.sp == sp) & (info.sq == sq) & (info.trend == trend)).to_numpy()]

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            found = [evaluate(*_usable(*_unpacked(row)), d, seasonal_d, m, 0, mask) for row in page.to_dict("records")]
            yield pd.DataFrame({"series_id": page["series_id"], "n": [f[5] for f in found], "sse": [f[1][0] for f in found], "params": [f[0][0] for f in found]})

    return packed.mapInPandas(batches, "series_id string, n long, sse double, params array<double>")


# -- driver subsets without lag terms ---------------------------------------------------

def _penalty(criterion: str, n: float, params: int) -> float:
    """What a criterion adds for its parameters; grows with them."""
    if criterion == "bic":
        return params * math.log(n)
    more = 2 * params * (params + 1) / (n - params - 1) if criterion == "aicc" and n - params - 1 > 0 else math.inf if criterion == "aicc" else 0.0
    return 2 * params + more


def least_criterion(mom: np.ndarray, criterion: str) -> tuple[float, int, float, int]:
    """``(criterion, mask, sse, parameters)`` of the best subset of the drivers behind a moment matrix ``(1, drivers, target)``.

    Branch and bound: a branch has drivers that are in and drivers that are open. With all of them the error is least, so the branch
    cannot get below that error with the parameters of those that are in. Stronger drivers are decided first; ties go to the smaller mask.
    """
    n, k = mom[0, 0], len(mom) - 2

    def error(chosen: list[int]) -> float:
        used = [0, *[1 + i for i in chosen]]
        a, c = mom[np.ix_(used, used)], mom[used, -1]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        b = np.linalg.lstsq(a / np.outer(scale, scale), c / scale, rcond=1e-12)[0] / scale
        return max(float(mom[-1, -1] - 2 * b @ c + b @ a @ b), 1e-300)

    def value(sse: float, size: int) -> float:
        return n * math.log(sse / n) + _penalty(criterion, n, size + 2)

    alone = error([])
    order = sorted(range(k), key=lambda i: error([i]))
    best = (value(alone, 0), 0, alone, 2)
    todo = [([], 0)]
    while todo:
        inside, at = todo.pop()
        open_ = order[at:]
        whole = error(inside + open_)
        if value(whole, len(inside)) > best[0] + 1e-9 * abs(best[0]):
            continue
        for chosen, sse in ((inside, None), (inside + open_, whole)):
            sse = error(chosen) if sse is None else sse
            found = (value(sse, len(chosen)), sum(1 << i for i in chosen), sse, len(chosen) + 2)
            best = min(best, found)
        if open_:
            todo += [(inside, at + 1), (inside + [order[at]], at + 1)]
    return best


def best_driver_subset(packed: DataFrame, names: tuple[str, ...], criterion: str = "aic") -> DataFrame:
    """``(series_id, driver_mask, sse, k, criterion)``: the least-squares fit with the least criterion among all subsets of the drivers."""
    if criterion not in ("aic", "aicc", "bic"):
        raise ValueError(f"no such criterion without held-out rows: {criterion}")

    def batches(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            best = [least_criterion(unpack(m), criterion) for m in page["moments"]]
            yield pd.DataFrame({"series_id": page["series_id"], "driver_mask": [b[1] for b in best], "sse": [b[2] for b in best], "k": [b[3] for b in best],
                                "criterion": [b[0] for b in best]})

    return packed.mapInPandas(batches, "series_id string, driver_mask long, sse double, k long, criterion double")

"""Tree ensembles on drivers, trained as one panel model over all series.

The target of each series is divided by its training mean, so series of any size share one
model; level and spread of the series are features next to the drivers. Penalties on leaf
weights are drawn and reported but have no counterpart in Spark's trees.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetcast.config import BOOSTING, RANDOM_FOREST, ForecastConfig
from fleetcast.operators.calendars import training
from fleetcast.operators.gram import design
from fleetcast.operators.regress import scoring_rows
from fleetcast.operators.windows import contiguous_fold
from fleetcast.session import by_series, materialize

# Search spaces, number of draws, seed, folds and sampling shares.
PENALTIES = (0.0, 0.001, 0.1, 1.0, 10.0, 100.0, 1e4, 1e7, 1e10)
DRAWS = 200
SEED = 42
FOLDS = 3
ROW_SHARE = 0.7
FEATURE_SHARE = "0.7"
DEFAULT_DEPTH = 6
SERIES_FEATURES = ("level", "spread")


@dataclass(frozen=True)
class Space:
    """Values per parameter; a candidate number is decoded in mixed radix, last parameter fastest."""

    # The penalties and weights of leaves that are tried.
    method: str
    trees: tuple[int, ...]
    depth: tuple[int | None, ...]
    rate: tuple[float, ...]
    child_weight: tuple[float, ...] = (1.0, 3.0, 7.0)
    gamma: tuple[float, ...] = (0.0, 1.0, 10.0)
    l2: tuple[float, ...] = PENALTIES
    l1: tuple[float, ...] = PENALTIES

    @property
    def axes(self) -> dict[str, tuple]:
        return {n: getattr(self, n) for n in ("trees", "depth", "rate", "child_weight", "gamma", "l2", "l1")}

    @property
    def size(self) -> int:
        n = 1
        for values in self.axes.values():
            n *= len(values)
        return n


def _even(first: int, last: int, n: int) -> tuple[int, ...]:
    return tuple(int(first + (last - first) * i / (n - 1)) for i in range(n))


# Tree counts, depths and learning rates that are tried.
FOREST_SPACE = Space(RANDOM_FOREST, _even(100, 2000, 10), (2, 4, 6, 8, 10), (1.0,))
BOOSTING_SPACE = Space(BOOSTING, _even(100, 1000, 10), (2, 4, 6, None), (0.1, 0.2, 0.5))


@dataclass(frozen=True)
class Budget:
    """How many candidates are tried. ``refine=None`` tries the whole refinement grid."""

    draws: int = DRAWS
    refine: int | None = None
    parallelism: int = 4


# -- candidates -------------------------------------------------------------------------

def _draw_order(seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("config_id").cast("string")))


def draw(spark: SparkSession, space: Space, n: int, seed: int = SEED) -> DataFrame:
    """``n`` candidates of the space without repetition, the same ones in every run."""
    out, radix = spark.range(space.size).withColumnRenamed("id", "config_id"), 1
    for name, values in reversed(space.axes.items()):
        at = (F.floor(F.col("config_id") / radix) % len(values)).cast("int")
        kind = "int" if name in ("trees", "depth") else "double"
        out = out.withColumn(name, F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at))
        radix *= len(values)
    return out.orderBy(_draw_order(seed), "config_id").limit(n).select("config_id", *space.axes)


# Finer values per drawn value.
FINER = {
    "rate": {1.0: (1.0,), 0.1: (0.001, 0.01, 0.05, 0.1), 0.2: (0.1, 0.2, 0.3), 0.5: (0.4, 0.5, 0.6)},
    "child_weight": {1.0: (0.5, 1.0, 1.5), 3.0: (2.0, 3.0, 4.0), 7.0: (5.0, 7.0, 10.0)},
    "gamma": {0.0: (0.0, 0.1, 0.5), 1.0: (0.5, 1.0, 3.0), 10.0: (6.0, 10.0)},
}


def refinement(drawn: DataFrame, target_mean: float) -> DataFrame:
    """Neighbors of each candidate: trees by tenths, depth by one, closer values elsewhere.

    The largest gamma also tries a tenth of the mean target.
    """
    out = drawn
    for name, table in FINER.items():
        values = F
        for value, near in table.items():
            listed = [F.lit(v) for v in near]
            if name == "gamma" and value == 10.0:
                listed.append(F.lit(0.1 * target_mean))
            values = values.when(F.col(name) == value, F.array(*listed))
        out = out.withColumn(name, F.explode(values))
    step = F.floor(F.col("trees") * 0.1).cast("int")
    trees = F.array_distinct(F.array(*[F.col("trees") + step * i for i in (-2, -1, 0, 1, 2)]))
    depth = F.when(F.col("depth").isNull(), F.array("depth")).otherwise(F.array(*[F.col("depth") + i for i in (-1, 0, 1)]))
    return out.withColumn("trees", F.explode(trees)).withColumn("depth", F.explode(depth))


# -- panel ------------------------------------------------------------------------------

def _features(rows: DataFrame, names: tuple[str, ...], series: DataFrame) -> DataFrame:
    joined = rows.join(series, "series_id")
    return VectorAssembler(inputCols=[*names, *SERIES_FEATURES], outputCol="features").transform(joined)


def series_features(product: DataFrame, config: ForecastConfig) -> DataFrame:
    """Level and relative spread of each series in the training window."""
    level = F.coalesce(F.nullif(F.avg("y"), F.lit(0.0)), F.lit(1.0))
    return training(product, config).groupBy("series_id").agg(
        level.alias("level"), (F.coalesce(F.stddev_samp("y"), F.lit(0.0)) / F.abs(level)).alias("spread"))


def panel(product: DataFrame, drivers: DataFrame, config: ForecastConfig) -> tuple[DataFrame, tuple[str, ...]]:
    """Training rows of all series with features, scaled target and fold (in time, per series)."""
    rows, names = design(product, drivers, config)
    train = by_series(training(rows, config).where("y IS NOT NULL")).withColumn("fold", contiguous_fold(FOLDS) - 1)
    framed = _features(train, names, series_features(product, config))
    return framed.select("series_id", "ds", "fold", "features", (F.col("y") / F.col("level")).alias("target"), "y"), names


def _estimator(space: Space, c: dict, gain_unit: float):
    """Spark's estimator for a candidate. The split gain is given per unit of the raw target."""
    common = dict(
        labelCol="target", featuresCol="features", predictionCol="scaled", seed=SEED, subsamplingRate=ROW_SHARE,
        maxDepth=DEFAULT_DEPTH if c["depth"] is None else max(int(c["depth"]), 1),
        minInstancesPerNode=max(int(-(-c["child_weight"] // 1)), 1), minInfoGain=c["gamma"] * gain_unit)
    if space.method == RANDOM_FOREST:
        return RandomForestRegressor(numTrees=int(c["trees"]), featureSubsetStrategy=FEATURE_SHARE, **common)
    return GBTRegressor(maxIter=int(c["trees"]), stepSize=c["rate"], **common)


# -- cross-validation -------------------------------------------------------------------

def _forest_errors(data: DataFrame, space: Space, cands: list[dict], gain_unit: float, parallelism: int) -> list[float]:
    base = _estimator(space, cands[0], gain_unit)
    maps = []
    for c in cands:
        e = _estimator(space, c, gain_unit)
        grid = ParamGridBuilder()
        for name in ("numTrees", "maxDepth", "minInstancesPerNode", "minInfoGain"):
            grid = grid.addGrid(base.getParam(name), [e.getOrDefault(name)])
        maps += grid.build()
    judge = RegressionEvaluator(labelCol="target", predictionCol="scaled", metricName="mse")
    cv = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=judge, numFolds=FOLDS, foldCol="fold", parallelism=parallelism)
    return list(cv.fit(data).avgMetrics)


def _boosting_errors(data: DataFrame, space: Space, cands: list[dict], gain_unit: float, parallelism: int) -> list[float]:
    """A boosted model contains all shorter ones: candidates that differ only in the number
    of trees share one fit, whose error after every iteration is read off."""
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(cands):
        groups.setdefault((c["depth"], c["rate"], c["child_weight"], c["gamma"]), []).append(i)

    def fit(members: list[int], fold: int) -> list[tuple[int, float]]:
        longest = max((cands[i] for i in members), key=lambda c: c["trees"])
        model = _estimator(space, longest, gain_unit).fit(data.where(F.col("fold") != fold))
        errors = model.evaluateEachIteration(data.where(F.col("fold") == fold), "squared")
        return [(i, errors[int(cands[i]["trees"]) - 1]) for i in members]

    total = [0.0] * len(cands)
    with ThreadPoolExecutor(parallelism) as pool:
        for found in pool.map(lambda job: fit(*job), [(g, f) for g in groups.values() for f in range(FOLDS)]):
            for i, e in found:
                total[i] += e / FOLDS
    return total


@dataclass
class Tuned:
    """Outcome of a search: both stages with their scores, and the model of the one kept."""

    stage: str
    candidate: dict
    scores: dict[str, float]
    model: object
    names: tuple[str, ...]


def _lowest(cands: list[dict], errors: list[float]) -> tuple[dict, float]:
    i = min(range(len(cands)), key=lambda j: (errors[j], j))
    return cands[i], errors[i]


def tune(product: DataFrame, drivers: DataFrame, config: ForecastConfig, space: Space, budget: Budget = Budget()) -> Tuned:
    """Random search, refinement around its winner, and a final fit of the better of the two."""
    spark = product.sparkSession
    framed, names = panel(product, drivers, config)
    data = materialize(framed, "panel")
    data.persist()
    try:
        # One number for the whole fleet: the mean target, the unit of the split gain.
        target_mean = data.agg(F.avg("y")).first()[0]
        gain_unit = 1.0 / (target_mean * target_mean or 1.0)
        errors_of: Callable = _forest_errors if space.method == RANDOM_FOREST else _boosting_errors
        # Candidates are parameters of Spark jobs: at most ``draws`` and one refinement grid of them.
        chosen = draw(spark, space, budget.draws)
        drawn = [r.asDict() for r in chosen.collect()]
        random_best, random_error = _lowest(drawn, errors_of(data, space, drawn, gain_unit, budget.parallelism))
        around = refinement(chosen.where(F.col("config_id") == random_best["config_id"]), target_mean)
        near = [r.asDict() for r in around.orderBy("trees", "depth", "rate", "child_weight", "gamma").collect()]
        if budget.refine is not None:
            near = near[:: max(len(near) // budget.refine, 1)][:budget.refine]
        fine_best, fine_error = _lowest(near, errors_of(data, space, near, gain_unit, budget.parallelism))
        stage, best = ("refined", fine_best) if fine_error <= random_error else ("random", random_best)
        model = _estimator(space, best, gain_unit).fit(data)
    finally:
        data.unpersist()
    return Tuned(stage, best, {"random": random_error, "refined": fine_error}, model, names)


# -- results ----------------------------------------------------------------------------

def forecast(tuned: Tuned, product: DataFrame, drivers: DataFrame, config: ForecastConfig, method: str) -> DataFrame:
    rows, names = scoring_rows(product, drivers, config)
    framed = _features(rows, names, series_features(product, config))
    return tuned.model.transform(framed).select(
        "series_id", "ds", F.lit(method).alias("method"), "kind", (F.col("scaled") * F.col("level")).alias("yhat"))


def importances(tuned: Tuned, spark: SparkSession, method: str) -> DataFrame:
    """Share of each feature in the split gain, largest first."""
    names = [*tuned.names, *SERIES_FEATURES]
    rows = [(method, n, float(v)) for n, v in zip(names, tuned.model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "method string, name string, value double").orderBy(F.desc("value"), "name")


def parameters(tuned: Tuned, spark: SparkSession, method: str) -> DataFrame:
    """Chosen values, the stage they come from, and the error of both stages."""
    rows = [(method, n, None if v is None else float(v), "None" if v is None else None) for n, v in tuned.candidate.items() if n != "config_id"]
    rows += [(method, f"cv error {n}", float(v), None) for n, v in tuned.scores.items()] + [(method, "stage", None, tuned.stage)]
    return spark.createDataFrame(rows, "method string, name string, value double, text string")


def smaller(space: Space, trees: tuple[int, ...]) -> Space:
    """The same space with other tree counts, for small machines."""
    return replace(space, trees=trees)

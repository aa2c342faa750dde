"""Tree ensembles: drawn candidates, search, refinement, importances, forecasts.

The registered runs use few candidates and few trees, because every candidate is a chain
of Spark jobs; the search code and the data are the same as with the full budget.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fleetcast.catalog.base import MONTHLY, query, series_inputs, sql
from fleetcast.config import BOOSTING, RANDOM_FOREST
from fleetcast.functions.scalars import rounded
from fleetcast.operators import trees
from fleetcast.sources import star

BUDGET = trees.Budget(draws=3, refine=3, parallelism=4)
SMALL_FOREST = trees.smaller(trees.FOREST_SPACE, (20, 40))
SMALL_BOOSTING = trees.smaller(trees.BOOSTING_SPACE, (6, 12))


def _tuned(spark, d, space):
    product, drivers = series_inputs(spark, d)
    return trees.tune(product, drivers, MONTHLY, space, BUDGET), product, drivers


def _drawn_sql(space: trees.Space) -> str:
    radix, columns = 1, []
    for name, values in reversed(space.axes.items()):
        kind = "INTEGER" if name in ("trees", "depth") else "DOUBLE"
        listed = ", ".join("NULL" if v is None else str(v) for v in values)
        columns.append(f"([{listed}]::{kind}[])[(config_id // {radix}) % {len(values)} + 1] AS {name}")
        radix *= len(values)
    return f"""
drawn AS (
  SELECT config_id, {", ".join(columns)} FROM (SELECT UNNEST(generate_series(0, {space.size - 1})) AS config_id)
  ORDER BY md5('42-' || config_id), config_id LIMIT 200)"""


PANEL = """
panel AS (
  SELECT p.y, NTILE(3) OVER (PARTITION BY p.series_id ORDER BY p.ds) - 1 AS fold FROM product_monthly p JOIN driver_monthly m ON p.ds = m.ds
  WHERE p.ds >= DATE '1996-01-01' AND p.ds < DATE '2000-07-01')"""


def _draw_sql(space: trees.Space) -> str:
    return sql("""
SELECT c.* REPLACE (COALESCE(depth, 0) AS depth), f.fold, f.test_rows,
       CAST(SUM(f.test_rows) OVER (PARTITION BY config_id) AS BIGINT) - f.test_rows AS train_rows
FROM drawn c CROSS JOIN (SELECT fold, COUNT(*) AS test_rows FROM panel GROUP BY 1) f""", _drawn_sql(space), PANEL)


def _draws(space):
    def run(spark, d):
        """Every drawn candidate with the rows it is trained and tested on per fold."""
        framed, _ = trees.panel(star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start), star.driver_monthly(spark, d), MONTHLY)
        sizes = framed.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("test_rows"))
        folds = F.explode(F.array(*[F.lit(f).cast("long") for f in range(trees.FOLDS)])).alias("fold")
        plan = trees.draw(spark, space, trees.DRAWS).select("*", folds).join(sizes, "fold")
        everything = F.sum("test_rows").over(Window.partitionBy("config_id"))
        return plan.withColumn("train_rows", everything - F.col("test_rows")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    return run


query("t3_random_draw_forest", _draw_sql(trees.FOREST_SPACE))(_draws(trees.FOREST_SPACE))
query("t3_random_draw_boosting", _draw_sql(trees.BOOSTING_SPACE))(_draws(trees.BOOSTING_SPACE))


@query("t1_random_forest")
def t1(spark, d):
    tuned, product, drivers = _tuned(spark, d, SMALL_FOREST)
    return trees.forecast(tuned, product, drivers, MONTHLY, RANDOM_FOREST)


@query("t2_gradient_boosting")
def t2(spark, d):
    tuned, product, drivers = _tuned(spark, d, SMALL_BOOSTING)
    return trees.forecast(tuned, product, drivers, MONTHLY, BOOSTING)


@query("t4_refinement_grid", sql("""
SELECT config_id, UNNEST(list_distinct([trees - 2 * step, trees - step, trees, trees + step, trees + 2 * step])) AS trees,
       depth, rate, child_weight, gamma, l2, l1
FROM (SELECT *, CAST(floor(trees * 0.1) AS INTEGER) AS step FROM (
  SELECT config_id, trees, COALESCE(depth, 0) AS depth, rate, child_weight, ROUND(gamma, 2) AS gamma, l2, l1 FROM (
    SELECT config_id, trees, l2, l1, rate, child_weight, gamma, UNNEST(CASE WHEN depth IS NULL THEN [NULL] ELSE [depth - 1, depth, depth + 1] END) AS depth FROM (
      SELECT * REPLACE (UNNEST(CASE gamma WHEN 0 THEN [0, 0.1, 0.5] WHEN 1 THEN [0.5, 1, 3] ELSE [6, 10, 0.1 * (SELECT AVG(y) FROM panel)] END::DOUBLE[]) AS gamma) FROM (
        SELECT * REPLACE (UNNEST(CASE child_weight WHEN 1 THEN [0.5, 1, 1.5] WHEN 3 THEN [2, 3, 4] ELSE [5, 7, 10] END::DOUBLE[]) AS child_weight) FROM (
          SELECT * REPLACE (UNNEST(CASE rate WHEN 0.1 THEN [0.001, 0.01, 0.05, 0.1] WHEN 0.2 THEN [0.1, 0.2, 0.3] ELSE [0.4, 0.5, 0.6] END::DOUBLE[]) AS rate)
          FROM drawn))))))""", _drawn_sql(trees.BOOSTING_SPACE), PANEL))
def t4(spark, d):
    """Neighbors of every drawn candidate of the full space; one gamma follows from the data."""
    framed, _ = trees.panel(star.product_monthly(spark, d, MONTHLY.train_start, MONTHLY.forecast_start), star.driver_monthly(spark, d), MONTHLY)
    mean = framed.agg(F.avg("y")).first()[0]
    grid = trees.refinement(trees.draw(spark, trees.BOOSTING_SPACE, trees.DRAWS), mean)
    return grid.withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("gamma", rounded(F.col("gamma"), 2))


@query("t5_kept_stage")
def t5(spark, d):
    tuned, _, _ = _tuned(spark, d, SMALL_FOREST)
    return trees.parameters(tuned, spark, RANDOM_FOREST)


@query("t6_feature_importance")
def t6(spark, d):
    tuned, _, _ = _tuned(spark, d, SMALL_BOOSTING)
    return trees.importances(tuned, spark, BOOSTING)


@query("o2_importance_ranking")
def o2(spark, d):
    tuned, _, _ = _tuned(spark, d, SMALL_FOREST)
    # A handful of rows: one per feature of the model.
    order = Window.orderBy(F.desc("value"), "name")
    return trees.importances(tuned, spark, RANDOM_FOREST).withColumn("place", F.row_number().over(order).cast("long"))

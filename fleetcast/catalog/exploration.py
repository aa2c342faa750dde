"""Decomposition, outliers, correlations, and the groups of scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fleetcast.catalog.base import MONTHLY, query, sql
from fleetcast.catalog.calendar_joins import CORRELATION, correlation_frame
from fleetcast.catalog.ingest import product_any
from fleetcast.functions import dates
from fleetcast.functions.scalars import alpha_grid, box_cox, inverse_box_cox, rounded, soft_threshold
from fleetcast.operators import calendars, explore, smooth, stl
from fleetcast.sources import star


def _parts_sql(table: str, m: int) -> str:
    return f"""
trended AS (
  SELECT series_id, ds, y, (ROW_NUMBER() OVER o - 1) % {m} AS pos,
         CASE WHEN COUNT(y) OVER f = {m} THEN AVG(y) OVER f END AS trend
  FROM {table} WINDOW o AS (PARTITION BY series_id ORDER BY ds),
    f AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {m // 2} PRECEDING AND {m - 1 - m // 2} FOLLOWING)),
seasoned AS (SELECT *, AVG(y - trend) OVER (PARTITION BY series_id, pos) AS seasonal FROM trended),
parts AS (SELECT *, y - trend - seasonal AS rest FROM seasoned)"""


# The trend is a mean of cents over one cycle, which has no ties at 4 decimals; season and
# rest are compared as shares of the mean level.
_ROUND_PARTS = ("ROUND(trend, 4) AS trend, ROUND(seasonal / AVG(y) OVER (PARTITION BY series_id), 9) + 0.0 AS seasonal_share, "
                "ROUND(rest / AVG(y) OVER (PARTITION BY series_id), 9) + 0.0 AS rest_share")


def _shown(parts):
    level = F.avg("y").over(Window.partitionBy("series_id"))
    return parts.select(
        "series_id", "ds", rounded(F.col("trend"), 4).alias("trend"), rounded(F.col("seasonal") / level, 9).alias("seasonal_share"),
        rounded(F.col("rest") / level, 9).alias("rest_share"))


@query("w4_moving_average", sql("SELECT series_id, ds, ROUND(trend, 4) AS trend FROM trended", _parts_sql("product_monthly", 12)))
def w4(spark, d):
    product = star.product_monthly(spark, d)
    return product.select("series_id", "ds", rounded(explore.moving_average(F.col("y"), 12), 4).alias("trend"))


@query("w5_seasonal_index", sql("""
SELECT series_id, ds, ROUND(seasonal / AVG(y) OVER (PARTITION BY series_id), 9) + 0.0 AS seasonal_share FROM parts""", _parts_sql("product_monthly", 12)))
def w5(spark, d):
    return _shown(explore.decompose(star.product_monthly(spark, d), 12)).select("series_id", "ds", "seasonal_share")


_Z_SQL = """
z AS (SELECT series_id, ds, (rest - AVG(rest) OVER (PARTITION BY series_id)) / stddev_samp(rest) OVER (PARTITION BY series_id) AS z FROM parts)"""
_Z_SELECT = "SELECT series_id, ds, ROUND(z, 5) + 0.0 AS z, COALESCE(abs(z) > 3, FALSE) AS outlier FROM z"


def _z(product, m):
    return explore.outliers(explore.decompose(product, m)).select(
        "series_id", "ds", rounded(F.col("z"), 5).alias("z"), "outlier")


@query("w6_residual_z", sql(_Z_SELECT, _parts_sql("product_daily", 7), _Z_SQL))
def w6(spark, d):
    return _z(star.product_daily(spark, d), 7)


@query("d1_decompose", sql(f"SELECT series_id, ds, {_ROUND_PARTS} FROM parts", _parts_sql("product_monthly", 12)))
def d1(spark, d):
    return _shown(explore.decompose(star.product_monthly(spark, d), 12))


@query("d1_decompose_daily", sql(f"SELECT series_id, ds, {_ROUND_PARTS} FROM parts", _parts_sql("product_daily", 7)))
def d1_daily(spark, d):
    return _shown(explore.decompose(star.product_daily(spark, d), 7))


@query("d1_decompose_drivers", sql(f"SELECT series_id, ds, {_ROUND_PARTS} FROM parts",
                                   "dl AS (SELECT driver AS series_id, ds, x AS y FROM driver_long)", _parts_sql("dl", 12)))
def d1_drivers(spark, d):
    drivers = star.driver_long(spark, d).select(F.col("driver").alias("series_id"), "ds", F.col("x").alias("y"))
    return _shown(explore.decompose(drivers, 12))


@query("d2_stl")
def d2(spark, d):
    return stl.decompose(star.product_monthly(spark, d), 12)


@query("d3_outliers", sql(_Z_SELECT, _parts_sql("product_monthly", 12), _Z_SQL))
def d3(spark, d):
    return _z(star.product_monthly(spark, d), 12)


@query("d3_outliers_stl")
def d3_stl(spark, d):
    return explore.outliers(stl.decompose(star.product_monthly(spark, d), 12))


# -- correlations -----------------------------------------------------------------------

@query("a22_correlation_matrix", sql("SELECT d1, d2, ROUND(r, 6) AS r FROM pairs", CORRELATION))
def a22(spark, d):
    return explore.correlations(correlation_frame(spark, d), star.DRIVERS).withColumn("r", rounded(F.col("r"), 6))


@query("a23_strong_pairs", sql("""
SELECT d1, d2, ROUND(r, 6) AS r FROM pairs
WHERE abs(r) >= 0.6 AND list_position(['n_orders', 'n_customers', 'urgent_orders', 'open_orders'], d1)
  < list_position(['n_orders', 'n_customers', 'urgent_orders', 'open_orders'], d2)""", CORRELATION))
def a23(spark, d):
    matrix = explore.correlations(correlation_frame(spark, d), star.DRIVERS)
    return explore.strong_pairs(matrix, star.DRIVERS).withColumn("r", rounded(F.col("r"), 6))


@query("j7_driver_pairs", sql("""
SELECT a.ds, a.driver AS d1, b.driver AS d2, a.x AS x1, b.x AS x2 FROM driver_long a JOIN driver_long b ON a.ds = b.ds
WHERE list_position(['n_orders', 'n_customers', 'urgent_orders', 'open_orders'], a.driver)
  < list_position(['n_orders', 'n_customers', 'urgent_orders', 'open_orders'], b.driver)"""))
def j7(spark, d):
    """Values of each pair of drivers side by side, taken from the columns of one row."""
    wide = star.driver_monthly(spark, d)
    pairs = [(a, b) for i, a in enumerate(star.DRIVERS) for b in star.DRIVERS[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2"), F.col(a).alias("x1"), F.col(b).alias("x2")) for a, b in pairs])
    return wide.select("ds", F.explode(cells).alias("p")).select("ds", "p.*")


@query("u3_driver_subsets", sql("""
SELECT mask, bit_count(CAST(mask AS BIGINT))::BIGINT AS size, COALESCE((
  SELECT string_agg(n, '+' ORDER BY n) FROM (SELECT UNNEST(names) AS n, UNNEST(generate_series(0, len(names) - 1)) AS p)
  WHERE (mask >> p) & 1 = 1), '') AS drivers
FROM (SELECT names, UNNEST(generate_series(0, (1 << len(names)) - 1)) AS mask
      FROM (SELECT list(DISTINCT driver ORDER BY driver) AS names FROM driver_long))"""))
def u3(spark, d):
    return explore.driver_subsets(star.driver_long(spark, d)).select(
        "mask", "size", F.array_join("drivers", "+").alias("drivers"))


# -- scalar functions -------------------------------------------------------------------

@query("f_date_parse_format", sql("""
SELECT series_id, ds, strftime(ds, '%d-%m-%Y') AS dashed, strftime(ds, '%d.%m.%Y') AS dotted,
       TRY_STRPTIME(strftime(ds, '%d/%m/%Y'), '%d/%m/%Y')::DATE AS back FROM product_daily"""))
def f_date_parse(spark, d):
    ds = F.col("ds")
    return star.product_daily(spark, d).select(
        "series_id", "ds", dates.report_date(ds).alias("dashed"), F.date_format(ds, "dd.MM.yyyy").alias("dotted"),
        dates.parse_day_first(F.date_format(ds, "dd/MM/yyyy")).alias("back"))


@query("f_date_arithmetic", sql("""
SELECT series_id, ds, date_diff('day', DATE '1995-01-01', ds) AS days, last_day(ds) AS month_end,
       CAST(ds + INTERVAL 1 MONTH AS DATE) AS next_month, ds + 1 AS next_day, ds + 7 AS next_week,
       CAST(date_trunc('month', ds + 20) AS DATE) AS first_day FROM product_any"""))
def f_date_arithmetic(spark, d):
    ds = F.col("ds")
    return product_any(spark, d).select(
        "series_id", "ds", F.datediff(ds, F.lit("1995-01-01")).cast("long").alias("days"), F.last_day(ds).alias("month_end"),
        dates.add_periods(ds, F.lit(1), "month").alias("next_month"), dates.add_periods(ds, F.lit(1), "day").alias("next_day"),
        dates.add_periods(ds, F.lit(1), "week").alias("next_week"), F.trunc(F.date_add(ds, 20), "MM").alias("first_day"))


@query("f_date_sequence", sql("""
SELECT series_id, UNNEST(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS ds
FROM (SELECT series_id, MIN(ds) AS lo, MAX(ds) AS hi FROM product_daily GROUP BY 1)"""))
def f_date_sequence(spark, d):
    spans = star.product_daily(spark, d).groupBy("series_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return spans.select("series_id", F.explode(dates.period_sequence(F.col("lo"), F.col("hi"), "week")).alias("ds"))


@query("f_math", sql("""
SELECT series_id, ds, ROUND(sqrt(y), 6) AS root, ROUND(pow(y, 0.25), 6) AS fourth, ROUND(abs(y - 1000000), 4) AS distance,
       round_even(y / 7, 2) AS rounded, ROUND(ln(0.5::DOUBLE * pow(10::DOUBLE, 10 - 12 * (month(ds) - 1) / 11::DOUBLE)), 8) AS log_alpha
FROM product_monthly"""))
def f_math(spark, d):
    y = F.col("y")
    return star.product_monthly(spark, d).select(
        "series_id", "ds", F.round(F.sqrt(y), 6).alias("root"), F.round(F.pow(y, F.lit(0.25)), 6).alias("fourth"),
        F.round(F.abs(y - 1000000), 4).alias("distance"), F.bround(y / 7, 2).alias("rounded"),
        F.round(F.ln(alpha_grid(F.month("ds") - 1, 12)), 8).alias("log_alpha"))


@query("f_box_cox", sql("""
SELECT series_id, ds, lam, ROUND(z, 6) AS z, ROUND(CASE WHEN lam = 0 THEN exp(z) ELSE pow(z * lam + 1, 1 / lam) END, 4) AS back
FROM (SELECT series_id, ds, lam, CASE WHEN lam = 0 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END AS z
      FROM product_monthly, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(lam))"""))
def f_box_cox(spark, d):
    lam = F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("lam")
    z = star.product_monthly(spark, d).select("series_id", "ds", "y", lam).withColumn("z", box_cox(F.col("y"), F.col("lam")))
    return z.select("series_id", "ds", "lam", F.round("z", 6).alias("z"),
                    F.round(inverse_box_cox(F.col("z"), F.col("lam")), 4).alias("back"))


@query("f_box_cox_lambda", sql("""
SELECT series_id, arg_max(lam, llf) AS lam FROM (
  SELECT series_id, lam, -COUNT(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(y) ELSE (pow(y, lam) - 1) / lam END))
         + (lam - 1) * SUM(ln(y)) AS llf
  FROM product_monthly, (SELECT -1 + 0.25::DOUBLE * i AS lam FROM (SELECT UNNEST(generate_series(0, 12)) AS i))
  WHERE ds >= DATE '1996-01-01' AND ds < DATE '2000-07-01' GROUP BY 1, 2) GROUP BY 1"""))
def f_box_cox_lambda(spark, d):
    return smooth.box_cox_lambda(calendars.training(star.product_monthly(spark, d), MONTHLY))


@query("f_soft_threshold", sql("""
SELECT driver, ds, ROUND(sign(x - 100) * greatest(abs(x - 100) - 20, 0), 6) + 0.0 AS shrunk FROM driver_long"""))
def f_soft_threshold(spark, d):
    return star.driver_long(spark, d).select(
        "driver", "ds", rounded(soft_threshold(F.col("x") - 100, F.lit(20.0)), 6).alias("shrunk"))


@query("f_strings", sql("""
SELECT p_brand, p_brand || '(t-' || p_size || ')' AS lag_name, contains(p_type, 'ECON') AS economy,
       array_to_string(list_sort(string_split(p_name, ' ')), ', ') AS words FROM part"""))
def f_strings(spark, d):
    return star.table(spark, d, "part").select(
        "p_brand", F.concat("p_brand", F.lit("(t-"), "p_size", F.lit(")")).alias("lag_name"), F.col("p_type").contains("ECON").alias("economy"),
        F.array_join(F.array_sort(F.split("p_name", " ")), ", ").alias("words"))


@query("f_arrays", sql("""
SELECT ds, list_contains([n_orders, n_customers, urgent_orders, open_orders], n_orders) AS has_orders,
       n_orders + n_customers + urgent_orders + open_orders AS total,
       len(list_filter([n_orders, n_customers, urgent_orders, open_orders], lambda x: x > 100)) AS large,
       list_sort([n_orders, n_customers, urgent_orders, open_orders])[1] AS least
FROM driver_monthly"""))
def f_arrays(spark, d):
    values = F.array(*[F.col(n) for n in star.DRIVERS])
    return star.driver_monthly(spark, d).select(
        "ds", F.array_contains(values, F.col("n_orders")).alias("has_orders"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.size(F.filter(values, lambda x: x > 100)).cast("long").alias("large"), F.array_sort(values)[0].alias("least"))


@query("f_maps_json", sql("""
SELECT ds, n_orders, open_orders, strftime(ds, '%d-%m-%Y') AS day, 4::BIGINT AS entries FROM driver_monthly"""))
def f_maps_json(spark, d):
    """A record with the values of a date, written as JSON and read back."""
    record = F.to_json(F.struct(dates.report_date(F.col("ds")).alias("day"), F.map_from_entries(F.array(*[
        F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in star.DRIVERS])).alias("values")))
    parsed = F.from_json(record, "day string, values map<string, double>")
    return star.driver_monthly(spark, d).select("ds", parsed.alias("r")).select(
        "ds", F.col("r.values")["n_orders"].alias("n_orders"), F.col("r.values")["open_orders"].alias("open_orders"),
        "r.day", F.size("r.values").cast("long").alias("entries"))


@query("f_nulls", sql("""
SELECT series_id, ds, lagged IS NULL AS missing, COALESCE(lagged, y) AS filled, COALESCE(NULLIF(lagged, 0) / y, 0) IS NOT NULL AS usable
FROM (SELECT *, LAG(y) OVER (PARTITION BY series_id ORDER BY ds) AS lagged FROM product_daily)"""))
def f_nulls(spark, d):
    lagged = star.product_daily(spark, d).withColumn("lagged", F.lag("y").over(Window.partitionBy("series_id").orderBy("ds")))
    return lagged.select(
        "series_id", "ds", F.col("lagged").isNull().alias("missing"), F.coalesce("lagged", "y").alias("filled"),
        F.coalesce(F.nullif(F.col("lagged"), F.lit(0.0)) / F.col("y"), F.lit(0.0)).isNotNull().alias("usable"))

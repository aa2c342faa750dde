"""Registration of queries with their SQL counterpart, and the shared fixtures."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from fleetcast.config import ForecastConfig
from fleetcast.session import materialize
from fleetcast.sources import star
from fleetcast.sources.star import DRIVERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MONTHLY = ForecastConfig(date(1996, 1, 1), date(2000, 7, 1), 12, "month", 12, drivers=DRIVERS)
MONTHLY_LATE = ForecastConfig(date(1996, 1, 1), date(2001, 3, 1), 12, "month", 12, drivers=DRIVERS)
DAILY = ForecastConfig(date(2024, 1, 1), date(2024, 1, 24), 7, "day", 7, drivers=DRIVERS)

FIXTURES = """
product_monthly AS (
  SELECT p_brand AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
product_total_monthly AS (
  SELECT 'total' AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM orders GROUP BY 2),
driver_monthly AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(COUNT(*) AS DOUBLE) AS n_orders, CAST(COUNT(DISTINCT o_custkey) AS DOUBLE) AS n_customers,
         CAST(SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS DOUBLE) AS urgent_orders,
         CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS open_orders
  FROM orders GROUP BY 1),
driver_long AS (
  SELECT ds, 'n_orders' AS driver, n_orders AS x FROM driver_monthly
  UNION ALL SELECT ds, 'n_customers', n_customers FROM driver_monthly
  UNION ALL SELECT ds, 'urgent_orders', urgent_orders FROM driver_monthly
  UNION ALL SELECT ds, 'open_orders', open_orders FROM driver_monthly),
product_daily AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS ds,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM events GROUP BY 1, 2),
product_fleet AS (
  SELECT p_brand || '|' || n_name AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
product_any AS (
  SELECT * FROM product_monthly UNION ALL SELECT * FROM product_total_monthly
  UNION ALL SELECT * FROM product_daily),
irregular AS (
  SELECT * FROM product_monthly WHERE ds <> DATE '1998-05-01' OR series_id > 'Brand#2'
  UNION ALL SELECT * FROM product_daily WHERE ds <> DATE '2024-01-15' OR series_id <> 'click')"""


def sql(select: str, *ctes: str) -> str:
    """Complete statement: fixtures, extra common table expressions, final select."""
    return "WITH RECURSIVE " + ",\n".join((FIXTURES,) + ctes) + "\n" + select


def eliminated(name: str, source: str, n: int) -> list[str]:
    """Steps of Gauss-Jordan elimination of ``source (key, i, j, v)``, ``n`` rows from 0; ``name`` has the solutions in columns ``j >= n``."""
    steps, last = [], source
    for k in range(n):
        into = name if k == n - 1 else f"{name}_{k}"
        steps.append(f"""
{into} AS MATERIALIZED (
  SELECT a.key, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * b.v / p.v END AS v FROM {last} a
  JOIN {last} p ON p.key = a.key AND p.i = {k} AND p.j = {k} JOIN {last} b ON b.key = a.key AND b.i = {k} AND b.j = a.j
  JOIN {last} c ON c.key = a.key AND c.i = a.i AND c.j = {k})""")
        last = into
    return steps


def query(name: str, oracle: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


# Months the canonical monthly run reads: its training window and horizon.
MONTHLY_SPAN = (date(1996, 1, 1), date(2001, 7, 1))


def product_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(star.product_monthly(spark, sf_dir, *MONTHLY_SPAN), "product")


def series_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Product and driver tables, written once: methods read them several times, the facts once."""
    return product_input(spark, sf_dir), materialize(star.driver_monthly(spark, sf_dir), "drivers")


def daily_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(star.product_daily(spark, sf_dir), "daily")

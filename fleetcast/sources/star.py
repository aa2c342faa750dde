"""Series and drivers derived from the star schema and the event table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetcast.session import fits_broadcast

DRIVERS = ("n_orders", "n_customers", "urgent_orders", "open_orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(name: str):
    """Amounts as whole cents: sums are exact in any order and stay in long arithmetic."""
    return F.round(F.col(name) * 100).cast("long").alias("cents")


def _month(name: str):
    return F.trunc(F.col(name), "MM").alias("ds")


def _amount():
    return (F.sum("cents") / F.lit(100.0)).alias("y")


def _within(df: DataFrame, column: str, since: date | None, until: date | None) -> DataFrame:
    """Restrict raw timestamps, not derived months: the bounds reach the file scan."""
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast(df.schema[column].dataType))
    return df if until is None else df.where(F.col(column) < F.lit(until).cast(df.schema[column].dataType))


def product_monthly(spark: SparkSession, sf_dir: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """``(series_id, ds, y)``: shipped value per brand and month, of months in ``since <= ds < until``."""
    items = _within(table(spark, sf_dir, "lineitem"), "l_shipdate", since, until).select(
        "l_partkey", _month("l_shipdate"), _cents("l_extendedprice"))
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    if not fits_broadcast(brands):
        # A dimension too large to broadcast is joined by shuffle: shrink every part
        # to one row per month first, so a hot part cannot fill one task.
        items = items.groupBy("l_partkey", "ds").agg(F.sum("cents").alias("cents"))
    joined = items.join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("series_id", "ds").agg(_amount())


def product_total_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(_month("o_orderdate"), _cents("o_totalprice"))
    return orders.groupBy("ds").agg(_amount()).select(F.lit("total").alias("series_id"), "ds", "y")


def driver_monthly(spark: SparkSession, sf_dir: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """Wide driver table ``(ds, n_orders, n_customers, urgent_orders, open_orders)``, of months in ``since <= ds < until``."""
    orders = _within(table(spark, sf_dir, "orders"), "o_orderdate", since, until).select(_month("o_orderdate"), "o_custkey", "o_orderpriority", "o_orderstatus")
    return orders.groupBy("ds").agg(
        F.count("*").cast("double").alias("n_orders"),
        F.countDistinct("o_custkey").cast("double").alias("n_customers"),
        F.count_if(F.col("o_orderpriority").startswith("1")).cast("double").alias("urgent_orders"),
        F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("open_orders"),
    )


def driver_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_monthly(spark, sf_dir).unpivot(["ds"], list(DRIVERS), "driver", "x")


def product_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("ds"), _cents("value")
    )
    return events.groupBy("series_id", "ds").agg(_amount())


def product_fleet(spark: SparkSession, sf_dir: str, place: str = "nation", since: date | None = None, until: date | None = None) -> DataFrame:
    """One series per brand and customer nation or region, of months in ``since <= ds < until``: the fleet used for benchmarks.

    Items are summed per order, brand and month before the order join, so an order with
    very many items is a few rows there; nations are attached to customers first, and the
    large join is left to adaptive execution, which splits skewed partitions.
    """
    items = _within(table(spark, sf_dir, "lineitem"), "l_shipdate", since, until).select(
        "l_orderkey", "l_partkey", _month("l_shipdate"), _cents("l_extendedprice"))
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("place"))
    if place == "region":
        regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("place"))
        nations = nations.drop("place").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    places = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "place")
    located = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "place")
    branded = items.join(brands, F.col("l_partkey") == F.col("p_partkey"))
    if not fits_broadcast(located):
        branded = branded.groupBy("l_orderkey", "p_brand", "ds").agg(F.sum("cents").alias("cents"))
    return (
        branded.join(located, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.concat_ws("|", "p_brand", "place").alias("series_id"), "ds")
        .agg(_amount())
    )

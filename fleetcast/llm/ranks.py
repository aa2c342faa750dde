"""Places of rows in sorted groups, and running totals, without a group ever being in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetcast.session import materialize

STEP = 65536  # rows of a running total that are summed in one window


def same(left: DataFrame, right: DataFrame, names: list[str], suffix: str) -> Column:
    """Equality of the columns ``names`` of ``left`` and ``names + suffix`` of ``right``; NULLs are equal."""
    return reduce(lambda x, y: x & y, [left[n].eqNullSafe(right[n + suffix]) for n in names])


def ranked(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``rank``, the place (from 0) of a row in its group by ``order``, NULLs first; written to the shared folder.

    Rows are dealt out by ranges of ``(group, order)``, so a large group covers several tasks; a row's place is its place in its
    range plus the group's rows in earlier ranges. Rows with equal keys are told apart by a number given before the sort.
    """
    spark = rows.sparkSession
    numbered = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), f"{label}-numbered")
    keys = [*group, *order, "__row"]
    ranges = numbered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ranges = materialize(ranges.select(*rows.columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), label)
    heads = ranges.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*[F.col(g) for g in group]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select(F.col("__part").alias("__part_h"), *[F.col(g).alias(f"{g}_h") for g in group], (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    joined = ranges.join(heads, same(ranges, heads, ["__part", *group], "_h"))
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("rank"))


def running(rows: DataFrame, weight: str, into: str) -> DataFrame:
    """``rows``, which have a gapless ``rank``, with the sum of ``weight`` over all smaller ranks."""
    block = rows.withColumn("__block", F.floor(F.col("rank") / STEP))
    sums = block.groupBy("__block").agg(F.sum(weight).alias("__sum"))
    sums = sums.select("__block", F.coalesce(F.sum("__sum").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(weight).over(W.partitionBy("__block").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn(into, inside).join(sums, "__block").withColumn(into, F.col(into) + F.col("__before")).drop("__block", "__before")

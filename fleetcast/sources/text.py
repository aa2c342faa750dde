"""Delimited and whitespace-separated text files of a wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetcast.operators.validate import drop_unnamed


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; typing happens after the checks. No inference pass over the data."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


def read_whitespace(spark: SparkSession, path: str) -> DataFrame:
    """Columns separated by runs of blanks; every file starts with the same header line."""
    lines = spark.read.text(path)
    header = lines.first()[0]
    names = header.split()
    cells = F.split(F.trim("value"), r"\s+")
    return lines.where((F.col("value") != header) & (F.trim("value") != "")).select(
        *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file name: ``csv`` in the name, otherwise whitespace-separated text."""
    return read_csv(spark, path) if "csv" in path.rsplit("/", 1)[-1] else read_whitespace(spark, path)


def wide_to_long(df: DataFrame, key: str = "series_id", value: str = "y_text") -> DataFrame:
    """First column is the date, every other column with a header is one series."""
    named = drop_unnamed(df)
    date_column, *columns = named.columns
    return named.withColumnRenamed(date_column, "date_text").unpivot(["date_text"], columns, key, value)


def long_to_wide(df: DataFrame, columns: list[str], key: str, value: str) -> DataFrame:
    """Explicit column list, so no extra pass is needed to find the columns."""
    return df.groupBy("ds").pivot(key, columns).agg(F.first(value))

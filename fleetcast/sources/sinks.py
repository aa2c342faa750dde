"""Writing result tables: separated text and columnar bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPORT_SEPARATOR = ";"


def write_csv(table: DataFrame, path: str) -> None:
    """One folder of ``;`` separated UTF-8 text per table, written by all tasks in parallel."""
    table.write.mode("overwrite").option("header", True).option("sep", REPORT_SEPARATOR).option("encoding", "UTF-8").csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", REPORT_SEPARATOR).csv(path)


def write_parquet(table: DataFrame, path: str) -> None:
    """Clustered by series: a reader of one series opens few files.

    A folder per series would make as many folders as there are series.
    """
    if "series_id" in table.columns:
        table = table.repartitionByRange("series_id").sortWithinPartitions("series_id")
    table.write.mode("overwrite").parquet(path)


def write_bundle(tables: dict[str, DataFrame], folder: str, run_name: str, formats: tuple[str, ...] = ("csv",)) -> dict[str, str]:
    """Every named table of a report below ``folder/run_name``; returns the paths."""
    written = {}
    for name, table in tables.items():
        for fmt in formats:
            path = f"{folder.rstrip('/')}/{run_name}/{fmt}/{name}"
            (write_csv if fmt == "csv" else write_parquet)(table, path)
            written[f"{fmt}:{name}"] = path
    return written

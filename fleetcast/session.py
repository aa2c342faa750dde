"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "fleetcast") -> SparkSession:
    """Session for tests and benchmarks; on a cluster use the session the cluster gives."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@cache
def _local_folder() -> str:
    """A folder of this machine, removed when this process ends."""
    folder = tempfile.mkdtemp(prefix="fleetcast-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may do without one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_folder()
    return base.rstrip("/")


_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned_tables(spark: SparkSession, keep: bool = False) -> Iterator[str]:
    """All tables written inside share one folder, which is removed at the end, after a failure too, unless it is to be kept.

    Results that still read these tables have to be written or collected inside. A manifest names the application and its start.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    about = {"application": spark.sparkContext.applicationId, "started": datetime.now(timezone.utc).isoformat()}
    spark.createDataFrame([(k, v) for k, v in about.items()], "name string, value string").coalesce(1).write.json(f"{folder}/manifest")
    token = _OWNER.set(folder)
    try:
        yield folder
    finally:
        _OWNER.reset(token)
        if not keep:
            remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder where Spark has it, which need not be a file system of the driver."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for a table: in the folder of the run that owns it, or else directly in the shared one."""
    return f"{_OWNER.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Survives lost executors, unlike cached blocks. Files that the query shuffled go as soon as the table is written: else they stay
    until the driver happens to collect its garbage, which it does by the number of queries and not by their size.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    vars(table)["_written"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from ``materialize`` that nothing reads any more."""
    for table in tables:
        remove_folder(table.sparkSession, vars(table)["_written"])


def fits_broadcast(df: DataFrame) -> bool:
    """True when Spark's own size estimate of ``df`` is below the broadcast limit."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(size) <= int(limit)


def by_series(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Spread keys over all cores once; later windows and aggregations by key reuse it.

    The explicit count keeps adaptive execution from merging small but compute-heavy
    partitions into one task.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)

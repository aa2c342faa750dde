"""Lag features and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def lag_features(df: DataFrame, names: tuple[str, ...], lags: tuple[int, ...], key: str = "series_id",
                 drop_incomplete: bool = True) -> DataFrame:
    """Columns ``x(t-i)`` for every lag and ``x(t)``; incomplete rows are dropped."""
    w = Window.partitionBy(key).orderBy("ds")
    lagged = [F.lag(n, i).over(w).alias(f"{n}(t-{i})") for i in lags for n in names]
    current = [F.col(n).alias(f"{n}(t)") for n in names]
    rest = [c for c in df.columns if c not in names]
    out = df.select(*rest, *lagged, *current)
    made = [f"{n}(t-{i})" for i in lags for n in names] + [f"{n}(t)" for n in names]
    return out.dropna(subset=made) if drop_incomplete else out


def contiguous_fold(k: int, key: str = "series_id") -> Column:
    """Unshuffled folds 1..k; the first folds take the remainder rows."""
    return F.ntile(k).over(Window.partitionBy(key).orderBy("ds"))


def walk_forward(df: DataFrame, k: int, test_size: int = 12, key: str = "series_id") -> DataFrame:
    """Expanding training windows: fold ``j`` tests the j-th last block of ``test_size`` rows.

    Every row is emitted once per fold that uses it (at most ``k`` times), with its role.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ds")))
    folds = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.struct(
        (k + 1 - j).cast("long").alias("fold"),
        F.when(F.col("block") == j, "test").when(F.col("block") > j, "train").alias("role")))
    return (
        df.withColumn("block", F.ceil(back / F.lit(test_size)))
        .withColumn("f", F.explode(F.filter(folds, lambda f: f["role"].isNotNull())))
        .select("*", "f.fold", "f.role").drop("f", "block")
    )

"""Expanding walk-forward folds with an embargo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: horizon -> (embargo, block length, block bounds), fixed values.
HORIZONS = {1: (1, 10, (5, 15)), 5: (5, 15, (10, 20)), 21: (21, 21, (15, 42))}


def settings(horizon: int) -> tuple[int, int, tuple[int, int]]:
    if horizon not in HORIZONS:
        raise ValueError(f"no settings for a horizon of {horizon}")
    return HORIZONS[horizon]


def expanding_folds(matrix: DataFrame, n_splits: int = 5, embargo: int = 5) -> DataFrame:
    """Rows with fold_id and role: a row is in every fold that trains on it or tests it.

    Fold i of k tests rows [n - (k - i) * s, n - (k - i - 1) * s) with s = n // (k + 1); it trains on the rows
    that end ``embargo`` before them.  Symbols too short for a training row in the first fold have no folds.
    """
    if n_splits < 1 or embargo < 0:
        raise ValueError("n_splits must be at least 1 and the embargo at least 0")
    w = Window.partitionBy("symbol")
    step = F.expr(f"n div {n_splits + 1}")
    begin = F.col("n") - (F.lit(n_splits) - F.col("fold_id")) * F.col("step")
    return (
        matrix.withColumn("n", F.count("*").over(w)).withColumn("pos", F.row_number().over(w.orderBy("date")) - 1)
        .withColumn("step", step).where(F.col("step") >= 1).where(F.col("n") - n_splits * F.col("step") - embargo >= 1)
        .withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("begin", begin)
        .withColumn(
            "role",
            F.when(F.col("pos") < F.col("begin") - embargo, "train")
            .when((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + F.col("step")), "test"),
        )
        .where("role IS NOT NULL").drop("n", "step", "begin")
    )


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("symbol", "fold_id").agg(
        F.count_if(F.col("role") == "train").alias("train_size"), F.count_if(F.col("role") == "test").alias("test_size")
    )

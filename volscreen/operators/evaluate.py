"""Losses, summaries, regimes, inference and factor ranking over the out-of-sample panel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volscreen.functions.features import qlike_loss
from volscreen.operators.models import BASELINE, MODELS, feature_columns

#: Inclusive date windows, fixed values.
REGIMES = (("covid_crash", "2020-02-20", "2020-04-30"), ("bear_2022", "2022-01-03", "2022-10-14"))
METRICS = ("qlike", "mse", "mae")


def with_losses(panel: DataFrame) -> DataFrame:
    return panel.withColumn("qlike_loss", qlike_loss(F.col("y_true"), F.col("y_pred")))


def _metrics() -> list:
    gap = F.col("y_true") - F.col("y_pred")
    return [F.avg(qlike_loss(F.col("y_true"), F.col("y_pred"))).alias("qlike"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae")]


def fold_metrics(panel: DataFrame) -> DataFrame:
    return panel.na.drop("any", subset=["y_true", "y_pred"]).groupBy("symbol", "model", "fold_id").agg(*_metrics(), F.count("*").alias("test_size"))


def summarize(folds: DataFrame) -> DataFrame:
    """Means over folds, best QLIKE first."""
    return folds.groupBy("symbol", "model").agg(*[F.avg(m).alias(m) for m in METRICS]).orderBy("symbol", "qlike", "model")


def regime_metrics(panel: DataFrame, regimes=REGIMES) -> DataFrame:
    """symbol, regime, model, n_obs and metrics; an empty window has a row of n_obs 0 for every model."""
    names = F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for r, a, b in (("full_sample", "0001-01-01", "9999-12-31"), *regimes)])
    hit = F.filter(names, lambda w: (F.col("date") >= w["a"]) & (F.col("date") <= w["b"]))
    scored = panel.withColumn("regime", F.explode(F.transform(hit, lambda w: w["regime"]))).groupBy("symbol", "regime", "model").agg(F.count("*").alias("n_obs"), *_metrics())
    grid = panel.select("symbol", "model").distinct().withColumn("regime", F.explode(F.array(*[F.lit(r) for r in ("full_sample", *[x[0] for x in regimes])])))
    return grid.join(scored, ["symbol", "regime", "model"], "left").select("symbol", "regime", "model", F.coalesce("n_obs", F.lit(0)).alias("n_obs"), *METRICS)


def best_by_regime(regimes: DataFrame) -> DataFrame:
    return regimes.groupBy("symbol", "regime").agg(F.min_by("model", F.struct("qlike", "model")).alias("best_model"), F.min("qlike").alias("qlike"))


def differentials(panel: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """symbol, model, date, d: each challenger's loss less the baseline's on the same date."""
    losses = with_losses(panel).select("symbol", "model", "date", "qlike_loss")
    base = losses.where(F.col("model") == baseline).select("symbol", "date", F.col("qlike_loss").alias("base"))
    joined = losses.where(F.col("model") != baseline).join(base, ["symbol", "date"])
    return joined.select("symbol", "model", "date", (F.col("qlike_loss") - F.col("base")).alias("d")).na.drop()


def non_overlapping(diffs: DataFrame, horizon: int) -> DataFrame:
    """Every horizon-th date of each series."""
    w = Window.partitionBy("symbol", "model").orderBy("date")
    return diffs.withColumn("i", F.row_number().over(w) - 1).where(F.col("i") % horizon == 0).drop("i")


def diebold_mariano(diffs: DataFrame, horizon: int) -> DataFrame:
    """symbol, model, n_obs, mean_diff, dm, hln: Newey-West variance with horizon - 1 lags."""
    w = Window.partitionBy("symbol", "model").orderBy("date")
    x = diffs.withColumn("x", F.col("d") - F.avg("d").over(Window.partitionBy("symbol", "model")))
    lags = range(1, horizon)
    x = x.withColumns({f"p{k}": F.col("x") * F.lag("x", k).over(w) for k in lags})
    variance = F.sum(F.col("x") * F.col("x"))
    for k in lags:
        variance = variance + 2 * (1 - k / horizon) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0))
    t, h = F.col("n_obs"), horizon
    agg = x.groupBy("symbol", "model").agg(F.count("*").alias("n_obs"), F.avg("d").alias("mean_diff"), (variance / F.count("*")).alias("v"))
    fix = (t + 1 - 2 * h + h * (h - 1) / t) / t
    return (
        agg.withColumn("dm", F.when((F.col("v") > 0) & (t >= 2), F.col("mean_diff") / F.sqrt(F.col("v") / t)))
        .withColumn("hln", F.when(fix >= 0, F.col("dm") * F.sqrt(fix))).drop("v")
    )


def student_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t: the regularized incomplete beta by its continued fraction."""
    if t is None or not math.isfinite(t):
        return float("nan")
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    p = front * f / a
    return 1 - p if flip else p


def with_p_value(dm: DataFrame) -> DataFrame:
    """``dm`` and hln_p_value, two-sided with n_obs - 1 degrees of freedom; null where there is no statistic."""
    tail = F.udf(lambda t, n: None if t is None else student_tail(t, n - 1), "double")  # one row a model
    return dm.withColumn("hln_p_value", tail("hln", "n_obs"))


def bootstrap(diffs: DataFrame, block: int = 15, resamples: int = 1999, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """symbol, model, mean_diff, ci_low, ci_high, p_value, status of the moving-block bootstrap of the mean.

    A series shorter than a block has the status skipped_too_short and no interval.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("date")["d"].to_numpy(float)
        out = {"symbol": key[0], "model": key[1], "n_obs": len(d), "mean_diff": d.mean()}
        if len(d) < block:
            return pd.DataFrame([out | {"ci_low": None, "ci_high": None, "p_value": None, "status": "skipped_too_short"}])
        count = -(-len(d) // block)
        begin = np.random.default_rng(seed).integers(0, len(d) - block + 1, size=(resamples, count))
        means = np.array([d[(b[:, None] + np.arange(block)).ravel()[: len(d)]].mean() for b in begin])
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        p = (1 + int((np.abs(means - d.mean()) >= abs(d.mean())).sum())) / (1 + resamples)
        return pd.DataFrame([out | {"ci_low": low, "ci_high": high, "p_value": p, "status": "ok"}])

    schema = "symbol string, model string, n_obs long, mean_diff double, ci_low double, ci_high double, p_value double, status string"
    return diffs.groupBy("symbol", "model").applyInPandas(run, schema)


def summary_with_inference(panel: DataFrame, horizon: int = 5, block: int = 15, alpha: float = 0.05, resamples: int = 1999, seed: int = 0) -> DataFrame:
    """The race's summary with bootstrap and Diebold-Mariano columns; the baseline's are null."""
    diffs = differentials(panel)
    dm = with_p_value(diebold_mariano(diffs, horizon)).select("symbol", "model", "dm", "hln", "hln_p_value")
    test = bootstrap(diffs, block, resamples, alpha, seed).drop("status", "n_obs")
    joined = summarize(fold_metrics(panel)).join(test, ["symbol", "model"], "left").join(dm, ["symbol", "model"], "left")
    return joined.withColumn("significant_vs_baseline", (F.col("p_value") <= alpha) & (F.col("mean_diff") < 0)).orderBy("symbol", "qlike", "model")


def permutation_importance(folds: DataFrame, model: str = "ridge", horizon: int = 5, repeats: int = 5, seed: int = 0, cap: float | None = 1.0) -> DataFrame:
    """symbol, fold_id, feature, pos, importance: mean rise of the test QLIKE when a column is shuffled."""
    features, target, forecast = feature_columns(folds), f"target_rv_cc_{horizon}d", MODELS[model]

    def loss(y, p):
        f = np.maximum(p, 1e-8)
        return float(np.mean(np.log(f * f) + y * y / (f * f)))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        train, test = rows[rows.role == "train"], rows[rows.role == "test"].reset_index(drop=True)
        y, actual = train[target].to_numpy(float), test[target].to_numpy(float)
        copies = [test]
        for j, c in enumerate(features):
            for r in range(repeats):
                rng = np.random.default_rng(seed + 1000003 * int(key[1]) + 10007 * j + r)
                copies.append(test.assign(**{c: rng.permutation(test[c].to_numpy(float))}))
        pred = forecast(train, y, pd.concat(copies, ignore_index=True), features=features, horizon=horizon).reshape(len(copies), -1)
        losses = np.array([loss(actual, p) for p in pred])
        delta = (losses[1:] - losses[0]).reshape(len(features), repeats)
        if cap is not None:
            delta = np.clip(delta, -cap, cap)
        return pd.DataFrame({"symbol": key[0], "fold_id": key[1], "feature": features, "pos": np.arange(len(features)), "importance": delta.mean(axis=1)})

    kept = folds.select("symbol", "date", "fold_id", "role", target, *features)
    return kept.groupBy("symbol", "fold_id").applyInPandas(run, "symbol string, fold_id int, feature string, pos int, importance double")


def rank_features(importance: DataFrame, k: int = 5) -> DataFrame:
    """Mean, median, sample deviation (one fold: 0), folds and the share of folds in the top k."""
    w = Window.partitionBy("symbol", "fold_id").orderBy(F.desc("importance"), "pos")
    placed = importance.withColumn("place", F.row_number().over(w))
    return placed.groupBy("symbol", "feature").agg(
        F.avg("importance").alias("mean_importance"), F.percentile("importance", F.lit(0.5)).alias("median_importance"),
        F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("std_importance"), F.count("*").alias("n_folds"),
        (F.count_if(F.col("place") <= k) / F.count("*")).alias("top_k_hit_rate"),
    ).orderBy("symbol", F.desc("median_importance"), "feature")

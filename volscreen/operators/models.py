"""Forecasters, fitted and applied a (symbol, fold) at a time.

Those in closed form are aggregates over the training rows; the others run in pandas on groups of one
symbol's daily history, a few thousand rows whatever the number of symbols.  A model that a group is too
short for gives no rows there; ``fit_status`` says so.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR, EWMA_DECAY = 1e-8, 0.94
GRID = (0.80, 0.85, 0.90, 0.94, 0.97, 0.99)
HAR = ("rv_cc_1d", "rv_cc_5d", "rv_cc_21d")
RACE = ("har_rv_ols", "ridge", "lasso", "vix_as_forecast", "ou_rv", "ewma_recursive")
BASELINE = "har_rv_ols"


def _ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def recursive_ewma(train, y, test, column="rv_cc_1d", **_):
    grid = np.array(GRID)
    level, loss = np.full(len(grid), y[0]), np.zeros(len(grid))
    for v in y[1:]:
        loss += (v - level) ** 2
        level = grid * level + (1 - grid) * v
    best = int(np.argmin(loss))
    decay, state, out = grid[best], level[best], []
    for v in test[column].to_numpy(float):
        if np.isfinite(v):
            state = decay * state + (1 - decay) * v
        out.append(max(state, FLOOR))
    return np.array(out)


def penalized(l1: float, l2: float):
    """Least squares on standardized features: 1/2n |y - Xw|^2 + l1 |w|_1 + l2/2 |w|^2; l2 < 0 stands for -l2 / n."""

    def fit(train, y, features):
        x = train[features].to_numpy(float)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale == 0] = 1
        z, n = (x - mean) / scale, len(y)
        gram, moment = z.T @ z / n, z.T @ (y - y.mean()) / n
        ridge = -l2 / n if l2 < 0 else l2
        if l1 == 0:
            w = np.linalg.solve(gram + ridge * np.eye(len(gram)), moment)
        else:
            w, pull = np.zeros(len(gram)), gram.diagonal() + ridge
            for _round in range(5000):
                before = w.copy()
                for j in range(len(w)):
                    rest = moment[j] - gram[j] @ w + gram[j, j] * w[j]
                    w[j] = np.sign(rest) * max(abs(rest) - l1, 0) / pull[j] if pull[j] > 0 else 0.0
                if np.abs(w - before).max() < 1e-10 * max(np.abs(w).max(), 1e-300):
                    break
        return y.mean() - mean / scale @ w, w / scale

    return fit


def _linear(fit: Callable) -> Callable:
    def forecast(train, y, test, features=None, **_):
        base, slopes = fit(train, y, features)
        return np.maximum(base + test[features].to_numpy(float) @ slopes, FLOOR)

    return forecast


def _har_fit(train, y, _features):
    beta = _ols(train[list(HAR)].to_numpy(float), y)
    return beta[0], beta[1:]


#: Fits of the linear models: intercept and a coefficient a feature.
LINEAR: dict[str, Callable] = {
    "har_rv_ols": _har_fit,
    "ridge": penalized(0.0, -1.0),
    "lasso": penalized(0.001, 0.0),
    "elasticnet": penalized(0.0005, 0.0005),
}


MODELS: dict[str, Callable] = {
    "har_rv_ols": lambda train, y, test, **_: _linear(_har_fit)(train, y, test, features=list(HAR)),
    "ewma_recursive": recursive_ewma,
    **{m: _linear(LINEAR[m]) for m in ("ridge", "lasso", "elasticnet")},
}


#: Models in closed form, and the training rows that some models need (of them positive ones for ou_rv).
CLOSED = ("historical_mean", "ewma", "vix_as_forecast", "ou_rv")
LEAST = {"ou_rv": 30, "ewma_recursive": 30}


def register(name: str, forecast: Callable) -> None:
    """Add a model: ``forecast(train, y, test, features=..., horizon=...)`` on pandas rows gives a value a test row."""
    if name in MODELS or name in CLOSED:
        raise ValueError(f"{name} is a model already")
    MODELS[name] = forecast


def race_models(columns: list[str]) -> list[str]:
    """The race: implied volatility runs only where its column is."""
    seen = "vix_level" in columns or "vix_vol_daily" in columns
    return [m for m in RACE if m != "vix_as_forecast" or seen]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("symbol", "date", "pos", "fold_id", "role") and not c.startswith("target_")]


def _implied_column(folds: DataFrame) -> Column:
    if "vix_vol_daily" in folds.columns:
        return F.col("vix_vol_daily")
    return F.col("vix_level") / 100 / F.sqrt(F.lit(252.0)) if "vix_level" in folds.columns else F.lit(None).cast("double")


def _closed_forecasts(folds: DataFrame, models: list[str], horizon: int) -> DataFrame:
    """Mean, EWMA, implied volatility by least squares and the Ornstein-Uhlenbeck model as aggregates.

    A constant implied volatility forecasts the mean.
    """
    key, y, v = ("symbol", "fold_id"), F.col(f"target_rv_cc_{horizon}d"), _implied_column(folds)
    w = Window.partitionBy(*key).orderBy("date")
    x = F.when(y > 0, F.ln(y))
    train = folds.where("role = 'train'").select(
        *key, "date", y.alias("y"), v.alias("v"), x.alias("x"), F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*key)).alias("m"),
    )
    weight = F.when(F.col("i") == 1, F.pow(F.lit(EWMA_DECAY), F.col("m") - 1)).otherwise((1 - EWMA_DECAY) * F.pow(F.lit(EWMA_DECAY), F.col("m") - F.col("i")))
    lagged = F.when(F.col("x").isNotNull(), F.col("before"))
    fitted = train.groupBy(*key).agg(
        F.avg("y").alias("mean"), F.sum(F.col("y") * weight).alias("level"), F.regr_slope("y", "v").alias("slope"), F.regr_intercept("y", "v").alias("base"),
        F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.regr_slope(F.col("x"), lagged))).alias("phi"), F.regr_intercept(F.col("x"), lagged).alias("a"),
        F.max_by("x", F.when(F.col("x").isNotNull(), F.col("date"))).alias("last"), F.count("x").alias("positive"),
    )
    home = F.col("a") / (1 - F.col("phi"))
    drift = F.exp(home + F.pow("phi", F.lit(horizon)) * (F.col("last") - home))
    value = {
        "historical_mean": F.col("mean"),
        "ewma": F.col("level"),
        "vix_as_forecast": F.greatest(F.coalesce(F.col("base") + F.col("slope") * v, F.col("mean")), F.lit(FLOOR)),
        "ou_rv": F.when(F.col("positive") >= LEAST["ou_rv"], F.greatest(drift, F.lit(FLOOR))),
    }
    test = folds.where("role = 'test'").join(fitted, list(key))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), value[m].alias("y_pred")) for m in models]))
    rows = test.select(*key, "date", y.alias("y_true"), each.alias("of"))
    return rows.where("of.y_pred IS NOT NULL").select("symbol", "of.model", "fold_id", "date", "y_true", "of.y_pred")


def fit_status(folds: DataFrame, models: list[str], horizon: int = 5) -> DataFrame:
    """symbol, fold_id, model, n_train, status: ``ok``, or what kept the model from being fitted."""
    y = F.col(f"target_rv_cc_{horizon}d")
    sizes = folds.where("role = 'train'").groupBy("symbol", "fold_id").agg(F.count("*").alias("n_train"), F.count_if(y > 0).alias("positive"))
    needs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(LEAST.get(m, 1)).alias("least")) for m in models])).alias("need")
    have = F.when(F.col("need.model") == "ou_rv", F.col("positive")).otherwise(F.col("n_train"))
    status = F.when(have >= F.col("need.least"), "ok").otherwise(F.concat(F.lit("skipped_too_short: "), have, F.lit(" of "), F.col("need.least")))
    return sizes.select("symbol", "fold_id", "n_train", "positive", needs).select("symbol", "fold_id", "need.model", "n_train", status.alias("status"))


def forecasts(folds: DataFrame, models: list[str], horizon: int = 5) -> DataFrame:
    """symbol, model, fold_id, date, y_true, y_pred of every test row; one fit a model and fold."""
    features, target = feature_columns(folds), f"target_rv_cc_{horizon}d"
    unknown = [m for m in models if m not in MODELS and m not in CLOSED]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    closed, run = [m for m in models if m in CLOSED], {m: MODELS[m] for m in models if m not in CLOSED}
    if not run:
        return _closed_forecasts(folds, closed, horizon)

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        train, test = rows[rows.role == "train"], rows[rows.role == "test"]
        y = train[target].to_numpy(float)
        parts = [
            pd.DataFrame({"symbol": key[0], "model": name, "fold_id": key[1], "date": test["date"], "y_true": test[target], "y_pred": f(train, y, test, features=features, horizon=horizon)})
            for name, f in run.items()
            if len(y) >= LEAST.get(name, 1)
        ]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"symbol": [], "model": [], "fold_id": [], "date": [], "y_true": [], "y_pred": []})

    kept = folds.select("symbol", "date", "fold_id", "role", target, *features)
    fitted = kept.groupBy("symbol", "fold_id").applyInPandas(fit, "symbol string, model string, fold_id int, date date, y_true double, y_pred double")
    return fitted.unionByName(_closed_forecasts(folds, closed, horizon)) if closed else fitted


def coefficients(folds: DataFrame, model: str, horizon: int = 5) -> DataFrame:
    """symbol, fold_id, feature, pos, coefficient of a linear model, in units of the features (the intercept is feature null, pos -1)."""
    names, target, forecast = (list(HAR) if model == "har_rv_ols" else feature_columns(folds)), f"target_rv_cc_{horizon}d", LINEAR[model]

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        train = rows[rows.role == "train"].sort_values("date")
        base, slopes = forecast(train, train[target].to_numpy(float), names)
        return pd.DataFrame({"symbol": key[0], "fold_id": key[1], "feature": [None, *names], "pos": np.arange(-1, len(names)), "coefficient": [base, *slopes]})

    kept = folds.where("role = 'train'").select("symbol", "date", "fold_id", "role", target, *names)
    return kept.groupBy("symbol", "fold_id").applyInPandas(fit, "symbol string, fold_id int, feature string, pos int, coefficient double")

"""Whole studies: bars to matrices, matrices to the race, its inference, rankings and artifacts.

Symbols and folds stay columns: one job builds all matrices and one screens them all.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volscreen.functions import features as fx
from volscreen.operators import evaluate as ev
from volscreen.operators import features as ft
from volscreen.operators import folds as fd
from volscreen.operators import forest as rf
from volscreen.operators import models as md
from volscreen.plans import report
from volscreen.sources import artifacts as store
from volscreen.sources import bars as source

#: Models of the plain baseline experiment.
BASELINES = ("historical_mean", "ewma", "har_rv_ols")
#: Words of the option that adds features.
EXTRAS = ("vix", "jump", "iv_rv", "rates")


@dataclass(frozen=True)
class Extras:
    """Optional features; iv_rv brings the vix series with it."""

    vix: bool = False
    jump: bool = False
    iv_rv: bool = False
    rates: bool = False
    vix_symbol: str = "VIX"
    rates_symbol: str = "TNX"

    @classmethod
    def parse(cls, text: str | None) -> Extras:
        names = [t.strip().lower() for t in (text or "").split(",") if t.strip()]
        unknown = sorted(set(names) - set(EXTRAS))
        if unknown:
            raise ValueError(f"unknown extras: {', '.join(unknown)}; known: {', '.join(EXTRAS)}")
        return cls(**dict.fromkeys(names, True))


@dataclass(frozen=True)
class Screen:
    """Options of a screen; ``embargo`` and ``block`` of None follow the horizon."""

    horizon: int = 5
    n_splits: int = 5
    embargo: int | None = None
    block: int | None = None
    resamples: int = 1999
    alpha: float = 0.05
    seed: int = 0
    importance_repeats: int = 5
    importance_cap: float | None = 1.0
    shapley: bool = False

    def resolved(self) -> Screen:
        embargo, block = self.embargo, self.block
        if embargo is None or block is None:
            usual = fd.settings(self.horizon)
            embargo, block = usual[0] if embargo is None else embargo, usual[1] if block is None else block
        if self.horizon in fd.HORIZONS:
            low, high = fd.HORIZONS[self.horizon][2]
            if not low <= block <= high:
                raise ValueError(f"a block of {block} is outside {low} to {high}")
        if self.resamples < 1 or not 0 < self.alpha < 1:
            raise ValueError("resamples must be at least 1 and alpha between 0 and 1")
        return replace(self, embargo=embargo, block=block)


def ingest(bars: DataFrame, root: str) -> DataFrame:
    """Store checked bars; returns symbol, n_rows, first_date, last_date of what came in."""
    source.write_bars(bars, root)
    return bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def build_matrices(spark: SparkSession, market: str, matrices: str, symbols: Iterable[str], horizon: int = 5, extras: Extras = Extras()) -> DataFrame:
    """Matrices of all symbols in one job; returns symbol, n_rows, first_date, last_date."""
    wanted = [s.strip().upper() for s in symbols]
    families = (*fx.CORE, "jump") if extras.jump else fx.CORE
    vix = source.read_bars(spark, market, [extras.vix_symbol]) if extras.vix or extras.iv_rv else None
    rates = source.read_bars(spark, market, [extras.rates_symbol]) if extras.rates else None
    bars = source.read_bars(spark, market, wanted)
    matrix = ft.feature_matrix(bars, horizon, families, vix, rates, extras.iv_rv)
    store.write_matrix(matrix, matrices, horizon)
    made = store.read_matrix(spark, matrices, horizon, wanted)
    return made.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def baseline_experiment(matrix: DataFrame, horizon: int = 5, n_splits: int = 5, embargo: int | None = None) -> dict[str, DataFrame]:
    """Fold metrics, their means and fold sizes of the plain baselines."""
    folds = fd.expanding_folds(matrix, n_splits, horizon if embargo is None else embargo)
    metrics = ev.fold_metrics(md.forecasts(folds, list(BASELINES), horizon))
    return {"metrics": ev.summarize(metrics), "fold_metrics": metrics, "folds": fd.fold_sizes(folds)}


class Tables(dict):
    """Tables by name; ``release`` frees what they share."""

    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def screen_tables(matrix: DataFrame, options: Screen = Screen()) -> Tables:
    """All tables of a screen, by name.  Every model is fitted once a fold: the panel feeds all tables.

    Panel, summary and importance are persisted until ``release``.
    """
    o = options.resolved()
    folds = fd.expanding_folds(matrix, o.n_splits, o.embargo)
    models = md.race_models(matrix.columns)
    panel = md.forecasts(folds, models, o.horizon).persist()
    summary = ev.summary_with_inference(panel, o.horizon, o.block, o.alpha, o.resamples, o.seed).persist()
    thin = ev.non_overlapping(ev.differentials(panel), o.horizon)
    importance = ev.permutation_importance(folds, horizon=o.horizon, repeats=o.importance_repeats, seed=o.seed, cap=o.importance_cap).persist()
    tables = Tables({
        "metrics": summary,
        "fold_metrics": ev.fold_metrics(panel),
        "folds": fd.fold_sizes(folds),
        "importance": importance,
        "factor_ranking": ev.rank_features(importance),
        "metrics_by_regime": ev.regime_metrics(panel),
        "oos_losses": ev.with_losses(panel),
        "inference": summary.where(F.col("model") != md.BASELINE).drop(*ev.METRICS),
        "inference_sensitivity": ev.bootstrap(thin, o.block, o.resamples, o.alpha, o.seed),
        "fit_status": md.fit_status(folds, models, o.horizon),
    })
    tables.held = (panel, summary, importance)
    if o.shapley:
        tables["shapley_importance"] = rf.forest_importance(folds, o.horizon)
    return tables


def screen(matrix: DataFrame, artifacts: store.ArtifactStore, experiment: str, options: Screen = Screen()) -> dict[str, list[dict]]:
    """Run a screen, keep its tables and one memo a symbol, and return the rows of the tables."""
    o = options.resolved()
    if matrix.isEmpty():
        raise ValueError("the feature matrix is empty")
    tables = screen_tables(matrix, o)
    rows = {name: store.records(t) for name, t in tables.items()}  # results, not the input
    tables.release()
    for name, table in rows.items():
        artifacts.write_json(experiment, name, table)
    meta = {k: getattr(o, k) for k in o.__dataclass_fields__} | {"target": f"target_rv_cc_{o.horizon}d", "baseline": md.BASELINE}
    artifacts.write_json(experiment, "screen_meta", meta)
    links = []
    for symbol in sorted({r["symbol"] for r in rows["metrics"]}):
        own = {name: [r for r in table if r["symbol"] == symbol] for name, table in rows.items()}
        links.append(report.screen_memo(symbol, own, meta))
    artifacts.write_text(experiment, "report.html", "\n".join(links))
    return rows


def batch_rows(rows: dict[str, list[dict]]) -> list[dict]:
    """One row a symbol: best model, its QLIKE and the top feature of the first places of each table."""
    best: dict[str, dict] = {}
    for r in rows["metrics"]:
        best.setdefault(r["symbol"], {"symbol": r["symbol"], "best_model": r["model"], "best_qlike": r["qlike"], "top_feature": None})
    for r in rows["factor_ranking"]:
        if r["symbol"] in best and best[r["symbol"]]["top_feature"] is None:
            best[r["symbol"]]["top_feature"] = r["feature"]
    return list(best.values())


def screen_horizons(spark: SparkSession, matrices: str, symbols: Iterable[str], artifacts: store.ArtifactStore, experiment: str, horizons=tuple(fd.HORIZONS), options: Screen = Screen()) -> list[dict]:
    """A screen for each horizon, each with its own embargo and block, and one memo over all."""
    union: list[dict] = []
    for h in horizons:
        o = replace(options, horizon=h, embargo=None, block=None)
        rows = screen(store.read_matrix(spark, matrices, h, symbols), artifacts, f"{experiment}-{h}d", o)
        union += [{"horizon_days": h} | r for r in rows["metrics"]]
    artifacts.write_json(experiment, "metrics", union)
    artifacts.write_text(experiment, "report.html", report.horizons_memo(union))
    return union


def study(spark: SparkSession, market: str, matrices: str, artifacts: store.ArtifactStore, experiment: str, symbols: Iterable[str], options: Screen = Screen(), extras: Extras = Extras(), skip_features: bool = False) -> list[dict]:
    """Matrices (unless skipped) and the screen of all symbols; one row a symbol."""
    symbols = list(symbols)
    if not skip_features:
        build_matrices(spark, market, matrices, symbols, options.horizon, extras)
    rows = screen(store.read_matrix(spark, matrices, options.horizon, symbols), artifacts, experiment, options)
    out = batch_rows(rows)
    artifacts.write_json(experiment, "batch", out)
    return out

"""Stores, forest, memos and the command line, from raw bars to artifacts."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tests.test_golden import golden_bars
from volscreen.__main__ import main
from volscreen.operators.forest import Forest, forest_importance
from volscreen.operators.features import feature_matrix
from volscreen.operators.folds import expanding_folds
from volscreen.plans import report
from volscreen.plans.screen import Extras, Screen
from volscreen.serve import respond
from volscreen.sources.artifacts import ArtifactStore, BadName, StoreError, read_matrix, write_matrix


def small_forest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    x[:, 2] = rng.integers(0, 3, 120)
    y = 2 + 0.8 * x[:, 0] + 0.3 * x[:, 2] + rng.normal(0, 0.02, 120)
    return Forest(x, y, trees=6, depth=3), x, y


def test_forest_finds_the_signal():
    forest, x, y = small_forest()
    shares = forest.importances()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0
    assert np.abs(forest.predict(x) - y).mean() < 0.5 * np.abs(y - y.mean()).mean()


def test_shapley_equals_the_definition():
    forest, x, _ = small_forest()
    tree, row = forest.trees[0], x[5]

    def expected(known, node=0):
        j = tree.feature[node]
        if j < 0:
            return tree.value[node]
        low, high = tree.left[node], tree.right[node]
        if j in known:
            return expected(known, low if row[j] <= tree.cut[node] else high)
        share = tree.cover[low] / tree.cover[node]
        return share * expected(known, low) + (1 - share) * expected(known, high)

    want = np.zeros(3)
    for order in itertools.permutations(range(3)):
        for i, j in enumerate(order):
            want[j] += (expected(set(order[: i + 1])) - expected(set(order[:i]))) / 6
    got = tree.shapley(row[None])[0]
    assert got == pytest.approx(want)
    assert got.sum() == pytest.approx(tree.predict(row[None])[0] - expected(set()))


def test_forest_importance(spark):
    folds = expanding_folds(feature_matrix(golden_bars(spark)), 2, 5)
    rows = forest_importance(folds, trees=4).collect()
    assert len(rows) == 16 and all(r.importance >= 0 for r in rows)


def test_artifacts(tmp_path, spark):
    kept = ArtifactStore(str(tmp_path))
    kept.write_json("e-1", "t", spark.createDataFrame([("a", float("nan"), None), ("b", 1.5, 2)], "k string, x double, n int"))
    assert kept.read_json("e-1", "t") == [{"k": "a", "x": None, "n": None}, {"k": "b", "x": 1.5, "n": 2}]
    assert kept.experiments() == ["e-1"]
    with pytest.raises(FileNotFoundError):
        kept.read_json("e-1", "none")
    with pytest.raises(BadName):
        kept.read_json("../e", "t")
    kept.write_text("e-1", "bad.json", "{")
    with pytest.raises(StoreError):
        kept.read_json("e-1", "bad")


def test_served(tmp_path):
    kept = ArtifactStore(str(tmp_path))
    kept.write_json("e", "metrics", [{"model": "lasso"}])
    kept.write_text("bad", "metrics.json", "{")
    assert respond(kept, "/experiments/")[::2] == (200, '["bad", "e"]')
    assert respond(kept, "/experiments/e")[::2] == (200, '[{"model": "lasso"}]')
    paths = ("/experiments/none", "/experiments/e/report", "/experiments/%2e%2e", "/experiments/bad", "/")
    assert [respond(kept, p)[0] for p in paths] == [404, 404, 400, 500, 404]


def test_matrices_are_kept_by_horizon(tmp_path, spark):
    bars, root = golden_bars(spark), str(tmp_path / "m")
    write_matrix(feature_matrix(bars, 5), root, 5)
    write_matrix(feature_matrix(bars, 1), root, 1)
    five = read_matrix(spark, root, 5, ["spy"])
    assert five.count() == 226 and "target_rv_cc_5d" in five.columns and "target_rv_cc_1d" not in five.columns
    for bad in (lambda: read_matrix(spark, root, 21), lambda: read_matrix(spark, root, 5, ["QQQ"])):
        with pytest.raises(StoreError):
            bad()


def test_options():
    assert Extras.parse(" vix, jump") == Extras(vix=True, jump=True)
    with pytest.raises(ValueError, match="unknown"):
        Extras.parse("moon")
    assert (Screen(21).resolved().embargo, Screen(21).resolved().block) == (21, 21)
    assert Screen(5, embargo=7).resolved().embargo == 7
    for bad in (Screen(5, block=99), Screen(3), Screen(5, alpha=1.0)):
        with pytest.raises(ValueError):
            bad.resolved()


def test_memo_parts():
    assert report.gap_wording({"mean_diff": None}) == report.gap_wording({"mean_diff": math.nan}) == report.BASELINE_TEXT
    assert report.gap_wording({"mean_diff": -1.0, "significant_vs_baseline": True}) == report.SIGNIFICANT_TEXT
    assert report.gap_wording({"mean_diff": -1.0, "significant_vs_baseline": False}) == report.LOWER_TEXT
    assert report.gap_wording({"mean_diff": 1.0, "significant_vs_baseline": True}) == report.HIGHER_TEXT
    assert report.gap_wording({"mean_diff": 0.0}) == report.SIMILAR_TEXT
    rows = [{"feature": f"f{i}", "median_importance": 100.0 if i == 0 else 1.0} for i in range(30)]
    top = report.top_features(rows)
    assert len(top) == 20 and top[0]["drawn"] == 2 * report.percentile([100.0] + [1.0] * 19, 0.95)
    windows = [{"regime": "a", "model": m, "qlike": q} for m, q in (("x", 2.0), ("y", 1.0))] + [{"regime": "b", "model": "x", "qlike": None}]
    assert [(r["regime"], r["model"]) for r in report.best_by_regime(windows)] == [("a", "y"), ("b", None)]


def test_command_line(tmp_path, spark, capsys):
    raw = golden_bars(spark).toPandas().drop(columns="symbol").rename(columns={"close": "Adj Close"})
    raw.to_csv(tmp_path / "spy.csv", index=False)
    folders = [x for k in ("market", "matrices", "artifacts") for x in (f"--{k}", str(tmp_path / k))]
    assert main([*folders, "ingest", str(tmp_path / "spy.csv"), "--symbol", "spy"]) == 0
    assert main([*folders, "features", "spy", "--with", "jump"]) == 0
    assert main([*folders, "evaluate", "spy", "--splits", "2", "--experiment", "base"]) == 0
    assert main([*folders, "run", "spy", "--splits", "2", "--experiment", "study"]) == 0
    assert main([*folders, "run", "spy", "--horizon", "3", "--skip-features"]) == 1
    assert main([*folders, "info"]) == 0
    out = capsys.readouterr().out
    assert "252" in out and "SPY\tlasso\t-6.22" in out
    kept = ArtifactStore(str(tmp_path / "artifacts"))
    assert kept.experiments() == ["base", "study"]
    assert {r["model"] for r in kept.read_json("base", "metrics")} == {"historical_mean", "ewma", "har_rv_ols"}
    assert kept.read_json("study", "batch")[0]["best_model"] == "lasso"
    assert pd.DataFrame(kept.read_json("study", "oos_losses"))["model"].nunique() == 5
    assert "<svg" in kept.read_text("study", "report.html")

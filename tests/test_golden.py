"""The seeded 252-day source through features, folds, models and inference."""

import numpy as np
import pandas as pd
import pytest

from volscreen.operators.evaluate import fold_metrics, student_tail, summary_with_inference
from volscreen.operators.features import feature_matrix
from volscreen.operators.folds import expanding_folds
from volscreen.operators.models import forecasts, race_models

# QLIKE, MSE, MAE by model.
GOLDEN = {
    "lasso": (-6.22874604922422, 6.867225568920356e-05, 0.0063858772445144684),
    "ridge": (-6.224242382692198, 7.094530158885973e-05, 0.006400833608994115),
    "ou_rv": (-6.211374442764873, 7.021991150348993e-05, 0.00648031758027106),
    "har_rv_ols": (-6.1829265991347135, 7.661192683582918e-05, 0.006794115798024871),
    "ewma_recursive": (-0.5391960696346646, 0.0003171199537387807, 0.015369865254858079),
}
P_VALUES = {"lasso": (0.0475, 0.037417), "ridge": (0.0125, 0.030257), "ou_rv": (0.366, 0.345589)}


def golden_bars(spark):
    rng, n = np.random.RandomState(42), 252
    r, o, s, t = rng.normal(0.0005, 0.012, n), rng.normal(0, 0.002, n), np.abs(rng.normal(0, 0.005, n)), np.abs(rng.normal(0, 0.005, n))
    v = rng.uniform(3e7, 8e7, n).astype(int).astype(float)
    close = 400 * np.cumprod(1 + r)
    opened = close * (1 + o)
    days = pd.bdate_range("2020-01-01", periods=n).date
    pdf = pd.DataFrame({"symbol": "SPY", "date": days, "open": opened, "high": np.maximum(opened, close) * (1 + s), "low": np.minimum(opened, close) * (1 - t), "close": close, "volume": v})
    return spark.createDataFrame(pdf, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_golden(spark):
    matrix = feature_matrix(golden_bars(spark)).cache()
    assert matrix.count() == 226
    folds = expanding_folds(matrix, 2, 5)
    panel = forecasts(folds, race_models(matrix.columns)).cache()
    assert fold_metrics(panel).count() == 10
    rows = {x.model: x for x in summary_with_inference(panel).collect()}
    assert set(rows) == set(GOLDEN)
    for model, want in GOLDEN.items():
        assert (rows[model].qlike, rows[model].mse, rows[model].mae) == pytest.approx(want, rel=1e-6)
    for model, (p, hln) in P_VALUES.items():
        assert rows[model].p_value == pytest.approx(p, abs=1e-9)
        assert rows[model].hln_p_value == pytest.approx(hln, rel=1e-4)
    assert rows["har_rv_ols"].p_value is None


def test_student_tail():
    assert student_tail(0.0, 10) == 1.0
    assert student_tail(2.228138852, 10) == pytest.approx(0.05, rel=1e-6)

"""A random forest of shallow regression trees, its impurity importances and exact Shapley values.

Fitted a (symbol, fold) at a time like the other forecasters; every split looks at all features.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from volscreen.operators.models import FLOOR, MODELS, feature_columns

TREES, DEPTH, LEAST, SEED = 200, 4, 5, 0


class Tree:
    """Nodes as parallel lists; a leaf has the feature -1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, order: np.ndarray, weight: np.ndarray, depth: int, least: int):
        self.feature, self.cut, self.left, self.right, self.value, self.cover = [], [], [], [], [], []
        self.gain = np.zeros(x.shape[1])
        self._grow(x, y, order, weight, weight > 0, depth, least)

    def _grow(self, x, y, order, weight, member, depth, least) -> int:
        node, w = len(self.feature), weight[member]
        total = w.sum()
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, w @ y[member] / total), (self.cover, total)):
            column.append(v)
        found = self._split(x, y, order, weight, member, least) if depth and member.sum() >= 2 * least else None
        if found:
            j, cut, gain = found
            self.gain[j] += gain
            self.feature[node], self.cut[node] = j, cut
            low = x[:, j] <= cut
            self.left[node] = self._grow(x, y, order, weight, member & low, depth - 1, least)
            self.right[node] = self._grow(x, y, order, weight, member & ~low, depth - 1, least)
        return node

    @staticmethod
    def _split(x, y, order, weight, member, least):
        """Feature, threshold and fall of the squared error of the best split; None where none helps."""
        rows = order[member[order]].reshape(len(order), -1)  # members by feature, each in its order
        value = np.take_along_axis(x.T, rows, 1)
        w, wy = weight[rows].cumsum(axis=1), (weight * y)[rows].cumsum(axis=1)
        n, s = w[:, -1:], wy[:, -1:]
        a, b = w[:, :-1], wy[:, :-1]
        gain = b * b / a + (s - b) ** 2 / (n - a) - s * s / n
        gain[value[:, 1:] <= value[:, :-1]] = -1.0
        gain[:, : least - 1] = -1.0
        gain[:, gain.shape[1] - least + 1 :] = -1.0
        j, i = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, i] <= 1e-15 * max(abs(float(s[0, 0])), 1e-300):
            return None
        return int(j), (value[j, i] + value[j, i + 1]) / 2, float(gain[j, i])

    def leaves(self):
        """(value, cover share by feature, conditions by feature) of each leaf."""
        stack = [(0, {}, {})]
        while stack:
            node, share, conditions = stack.pop()
            j = self.feature[node]
            if j < 0:
                yield self.value[node], share, conditions
                continue
            for child, low in ((self.left[node], True), (self.right[node], False)):
                part = share.get(j, 1.0) * self.cover[child] / self.cover[node]
                stack.append((child, share | {j: part}, conditions | {j: [*conditions.get(j, []), (self.cut[node], low)]}))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, feature = np.zeros(len(x), int), np.array(self.feature)
        cut, left, right = np.array(self.cut), np.array(self.left), np.array(self.right)
        while (inner := feature[at] >= 0).any():
            here = at[inner]
            at[inner] = np.where(x[inner, feature[here]] <= cut[here], left[here], right[here])
        return np.array(self.value)[at]

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Exact values: a leaf is a product game of the few features on its path, an absent one counts by its cover."""
        out = np.zeros(x.shape)
        for value, share, conditions in self.leaves():
            players = list(share)
            meets = {j: np.all([(x[:, j] <= c) == low for c, low in conditions[j]], axis=0).astype(float) for j in players}
            for j in players:
                others = [p for p in players if p != j]
                for size in range(len(others) + 1):
                    scale = factorial(size) * factorial(len(others) - size) / factorial(len(players))
                    for present in combinations(others, size):
                        product = np.full(len(x), value * scale)
                        for p in others:
                            product *= meets[p] if p in present else share[p]
                        out[:, j] += product * (meets[j] - share[j])
        return out


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, seed: int = SEED):
        order = np.argsort(x, axis=0, kind="stable").T
        rng = np.random.default_rng(seed)
        draws = [np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float) for _ in range(trees)]
        self.trees = [Tree(x, y, order, w, depth, least) for w in draws]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)

    def importances(self) -> np.ndarray:
        """Each feature's share of the falls of squared error, averaged over trees; they add up to 1."""
        shares = [t.gain / t.gain.sum() for t in self.trees if t.gain.sum() > 0]
        return np.mean(shares, axis=0) if shares else np.zeros(len(self.trees[0].gain))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.shapley(x) for t in self.trees], axis=0)


def forest_forecast(train, y, test, features=None, **_):
    model = Forest(train[features].to_numpy(float), y)
    return np.maximum(model.predict(test[features].to_numpy(float)), FLOOR)


MODELS["random_forest"] = forest_forecast


def forest_importance(folds: DataFrame, horizon: int = 5, trees: int = TREES) -> DataFrame:
    """symbol, fold_id, feature, pos, importance, impurity_importance of the forest of each fold.

    ``importance`` is the mean absolute Shapley value over the fold's test rows, so that
    ``rank_features`` takes this table too.
    """
    features, target = feature_columns(folds), f"target_rv_cc_{horizon}d"

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        train, test = rows[rows.role == "train"], rows[rows.role == "test"]
        model = Forest(train[features].to_numpy(float), train[target].to_numpy(float), trees)
        values = np.abs(model.shapley(test[features].to_numpy(float))).mean(axis=0)
        return pd.DataFrame(
            {"symbol": key[0], "fold_id": key[1], "feature": features, "pos": np.arange(len(features)), "importance": values, "impurity_importance": model.importances()}
        )

    kept = folds.select("symbol", "date", "fold_id", "role", target, *features)
    return kept.groupBy("symbol", "fold_id").applyInPandas(
        run, "symbol string, fold_id int, feature string, pos int, importance double, impurity_importance double"
    )

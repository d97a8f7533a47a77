"""Experiment folders: small result tables as JSON, feature matrices as Parquet.

The JSON tables hold a row a model, fold, feature or test date of one experiment and are written by
the driver; matrices stay distributed and are kept apart by symbol and horizon.
"""

from __future__ import annotations

import json
import math
import re
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class StoreError(OSError):
    """Something stored that is missing or cannot be read."""


class BadName(ValueError):
    """A name that cannot be a file or a folder of the store."""


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def records(table: DataFrame) -> list[dict]:
    """Rows as dictionaries: NaN and infinities become null, dates ISO text."""
    return [{k: _plain(v) for k, v in row.asDict().items()} for row in table.toLocalIterator()]


class ArtifactStore:
    """JSON tables and memos under ``root/experiment``."""

    def __init__(self, root: str):
        self.root = Path(root)

    def path(self, experiment: str, file: str) -> Path:
        for name in (experiment, file):
            if not _NAME.fullmatch(name):
                raise BadName(f"not a name: {name!r}")
        return self.root / experiment / file

    def write_json(self, experiment: str, name: str, payload) -> Path:
        """``payload`` is a DataFrame or any JSON value."""
        value = records(payload) if isinstance(payload, DataFrame) else payload
        return self.write_text(experiment, f"{name}.json", json.dumps(value, indent=2, allow_nan=False))

    def write_text(self, experiment: str, file: str, text: str) -> Path:
        path = self.path(experiment, file)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return path

    def read_text(self, experiment: str, file: str) -> str:
        path = self.path(experiment, file)
        if not path.is_file():
            raise FileNotFoundError(f"{experiment} has no {file}")
        return path.read_text(encoding="utf-8")

    def read_json(self, experiment: str, name: str):
        text = self.read_text(experiment, f"{name}.json")
        try:
            return json.loads(text)
        except ValueError as e:
            raise StoreError(f"{experiment}/{name}.json is no JSON: {e}") from e

    def experiments(self) -> list[str]:
        return sorted(p.name for p in self.root.iterdir() if p.is_dir()) if self.root.is_dir() else []


def write_matrix(matrix: DataFrame, root: str, horizon: int) -> None:
    """One partition a (symbol, horizon); only those in ``matrix`` are replaced."""
    target = f"target_rv_cc_{horizon}d"
    if target not in matrix.columns:
        raise ValueError(f"the matrix has no {target}")
    matrix.withColumn("horizon_days", F.lit(horizon)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "horizon_days", "symbol"
    ).parquet(root)


def read_matrix(spark: SparkSession, root: str, horizon: int, symbols=None) -> DataFrame:
    """The stored matrix of one horizon; StoreError where it or a symbol is missing."""
    try:
        part = spark.read.option("basePath", root).parquet(f"{root}/horizon_days={horizon}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise StoreError(f"no matrix of horizon {horizon} under {root}") from e
    part = part.drop("horizon_days").withColumn("symbol", F.col("symbol").cast("string"))
    if symbols is not None:
        wanted = sorted({s.strip().upper() for s in symbols})
        part = part.where(F.col("symbol").isin(wanted))
        missing = set(wanted) - {r.symbol for r in part.select("symbol").distinct().collect()}  # at most the symbols asked for
        if missing:
            raise StoreError(f"no matrix of horizon {horizon} for {sorted(missing)}")
    names = [c for c in part.columns if c not in ("symbol", "date")]
    return part.select("symbol", "date", *names)

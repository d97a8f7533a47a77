"""Daily bars: (symbol, date, open, high, low, close, volume) in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
#: Storage symbol to vendor name.
VENDOR_NAMES = {"VIX": "^VIX", "TNX": "^TNX"}


def vendor_name(symbol: str) -> str:
    symbol = symbol.strip().upper()
    return VENDOR_NAMES.get(symbol, symbol)


def write_bars(bars: DataFrame, root: str) -> None:
    """One partition a symbol; only the partitions of the symbols in ``bars`` are replaced."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(root)


class MissingBars(FileNotFoundError):
    """Symbols that are not stored."""


def stored_symbols(spark: SparkSession, root: str, symbols) -> set[str]:
    """Those of ``symbols`` that are stored under ``root``: only their partitions are looked at."""
    wanted = sorted({s.strip().upper() for s in symbols})
    try:
        held = spark.read.schema(BARS).parquet(root).where(F.col("symbol").isin(wanted)).select("symbol").distinct()
        return {r.symbol for r in held.collect()}  # at most the symbols asked for
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def exists(spark: SparkSession, root: str, symbol: str) -> bool:
    return bool(stored_symbols(spark, root, [symbol]))


def read_bars(spark: SparkSession, root: str, symbols=None, start=None, end=None) -> DataFrame:
    """Stored bars; symbols prune partitions and the inclusive dates reach the scan.  MissingBars for a symbol that is not stored."""
    if symbols is not None:
        wanted = sorted({s.strip().upper() for s in symbols})
        missing = sorted({*wanted} - stored_symbols(spark, root, wanted))
        if missing:
            raise MissingBars(f"no bars of {missing} under {root}")
        bars = spark.read.schema(BARS).parquet(root).where(F.col("symbol").isin(wanted))
    else:
        bars = spark.read.schema(BARS).parquet(root)
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Raw text columns of CSV files with a header, for ``normalize_bars``."""
    return spark.read.option("header", True).csv(path)


def bars_of(rows: DataFrame, symbol, date, price, order) -> DataFrame:
    """Bars of priced rows: first and last price by ``order``, extremes, and the count as volume."""
    return rows.groupBy(F.upper(F.trim(symbol)).alias("symbol"), F.to_date(date).alias("date")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"),
    )

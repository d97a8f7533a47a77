"""Normalizing and checking raw bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
REQUIRED = (*PRICES, "volume")
ALIASES = {"adj close": "close", "adjusted close": "close"}


class BarError(ValueError):
    """A bar table that cannot be used."""


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Lower-case names, aliases resolved; a plain close beats an adjusted one, the first of equal names stays."""
    names = [n.strip().lower().replace("-", " ").replace("_", " ") for n in raw.columns]
    out, seen = [], set()
    for i, n in enumerate(names):
        if n in ALIASES and ALIASES[n] in names:
            continue
        n = ALIASES.get(n, n).replace(" ", "_")
        if n not in seen:
            seen.add(n)
            out.append((i, n))
    plain = raw.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in out])


def bound_breaks() -> dict[str, Column]:
    """Conditions that no bar may meet."""
    return {
        "negative_volume": F.col("volume") < 0,
        "high_too_low": F.col("high") < F.greatest("open", "close", "low"),
        "low_too_high": F.col("low") > F.least("open", "close", "high"),
    }


def bar_report(bars: DataFrame) -> DataFrame:
    """One row of counts by symbol: rows, nulls, duplicate sessions and broken bounds."""
    days = bars.groupBy("symbol", "date").agg(
        F.count("*").alias("n"),
        F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in REQUIRED])).alias("nulls"),
        *[F.count_if(c).alias(k) for k, c in bound_breaks().items()],
    )
    return days.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"), F.sum("nulls").alias("n_null_rows"), F.count_if(F.col("n") > 1).alias("n_duplicate_days"),
        *[F.sum(k).alias(f"n_{k}") for k in bound_breaks()],
    )


def normalize_bars(raw: DataFrame, symbol: str | None = None, date_col: str = "date") -> DataFrame:
    """Typed bars without null rows; raises BarError for what cannot be mended.

    Duplicate sessions are an error before null rows are dropped; dates are floored to UTC days.  All
    checks are one job over the input.
    """
    df = normalize_columns(raw)
    missing = [c for c in (*REQUIRED, date_col) if c not in df.columns]
    if missing:
        raise BarError(f"missing columns: {missing}")
    name = F.lit(symbol.strip().upper()) if symbol is not None else F.upper(F.trim("symbol"))
    day = F.try_to_timestamp(F.col(date_col).cast("string")).cast("date")
    typed = df.select(
        name.alias("symbol"), day.alias("date"), *[F.col(c).try_cast("double").alias(c) for c in REQUIRED],
        (F.col(date_col).isNotNull() & day.isNull()).alias("bad_date"),
        F.greatest(*[(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int") for c in REQUIRED]).alias("bad_number"),
    )
    bars = typed.drop("bad_date", "bad_number")
    whole = F.lit(True)
    for c in (*REQUIRED, "date"):
        whole = whole & F.col(c).isNotNull()
    days = typed.groupBy("symbol", "date").agg(
        F.count("*").alias("n"), F.count_if("bad_date").alias("bad_date"), F.sum("bad_number").alias("bad_number"),
        *[F.count_if(whole & c).alias(k) for k, c in bound_breaks().items()],
    )
    counts = ("bad_date", "bad_number", *bound_breaks())
    found = days.agg(F.count_if(F.col("n") > 1).alias("twice"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).first()
    if found.bad_date:
        raise BarError(f"{found.bad_date} dates cannot be read")
    if found.bad_number:
        raise BarError(f"{found.bad_number} rows hold text that is no number")
    if found.twice:
        raise BarError(f"duplicate sessions: {found.twice}")
    broken = {k: found[k] for k in bound_breaks()}
    if any(broken.values()):
        raise BarError(f"bounds broken: {broken}")
    return bars.na.drop(subset=[*REQUIRED, "date"])

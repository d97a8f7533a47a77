"""The feature matrix: all families of all symbols over one sort, auxiliary series as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volscreen.functions import features as fx


#: Days of a series that is broadcast; 200 years of sessions.
BROADCAST_DAYS = 50_000


def asof(primary: DataFrame, aux: DataFrame, columns: list[str]) -> DataFrame:
    """Backward as-of left join of one dated series onto every symbol's dates; exact dates match.

    The series' dates are turned into [date, next date) ranges and each month of a range into a key,
    so the join is an equal join on the month with a range check.  A series of at most BROADCAST_DAYS days
    is broadcast, so that the rows of all symbols of a month need not meet in one task.
    """
    nxt = F.lead("date").over(Window.partitionBy("series").orderBy("date"))
    horizon = primary.agg(F.max("date").alias("last"))
    spans = (
        aux.select(F.lit(0).alias("series"), "date", *columns).withColumn("till", nxt).crossJoin(F.broadcast(horizon))  # one row
        .withColumn("till", F.coalesce("till", F.greatest(F.date_add("last", 1), F.date_add("date", 1)))).where("date < till")
        .withColumn("month", F.explode(F.sequence(F.trunc("date", "month"), F.trunc(F.date_sub("till", 1), "month"), F.expr("interval 1 month"))))
        .select(F.col("date").alias("from"), "till", "month", *columns)
    )
    if aux.select("date").limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS:
        spans = F.broadcast(spans)  # a row a day and month of one series, at most BROADCAST_DAYS
    left = primary.withColumn("month", F.trunc("date", "month"))
    met = left.alias("p").join(
        spans.alias("s"), (F.col("p.month") == F.col("s.month")) & (F.col("p.date") >= F.col("s.from")) & (F.col("p.date") < F.col("s.till")), "left"
    )
    return met.select(*[F.col(f"p.{c}") for c in primary.columns], *[F.col(f"s.{c}") for c in columns])


def level_and_change(aux: DataFrame, name: str) -> DataFrame:
    """date, {name}_level, {name}_chg_1d; the change is on the series' own calendar."""
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(w)
    return aux.select("date", F.col("close").alias(f"{name}_level"), (F.try_divide(F.col("close"), before) - 1).alias(f"{name}_chg_1d"))


def feature_matrix(
    bars: DataFrame, horizon: int = 5, families=fx.CORE, vix: DataFrame | None = None, rates: DataFrame | None = None,
    iv_rv: bool = False, drop: bool = True,
) -> DataFrame:
    """symbol, date, features in family order, target_rv_cc_{h}d; rows with any null go."""
    unknown = [f for f in families if f not in fx.FAMILIES]
    if unknown or not families:
        raise ValueError(f"unknown or no feature families: {unknown}")
    if iv_rv and (vix is None or "har" not in families):
        raise ValueError("iv_rv needs the vix series and the har family")
    columns: dict = {}
    for f in families:
        columns |= fx.FAMILIES[f]()
    target = f"target_rv_cc_{horizon}d"
    base = bars.withColumn("r", fx.log_ratio(1)).withColumn("r_lag", F.lag("r").over(fx.by_date()))
    wide = base.select("symbol", "date", *[c.alias(k) for k, c in columns.items()], fx.forward_volatility(horizon).alias(target))
    names = list(columns)
    if vix is not None:
        wide = asof(wide, level_and_change(vix, "vix"), ["vix_level", "vix_chg_1d"])
        names += ["vix_level", "vix_chg_1d"]
        if iv_rv:
            more = fx.implied_minus_realized()
            wide = wide.withColumns(more)
            names += list(more)
    if rates is not None:
        wide = asof(wide, level_and_change(rates, "tnx"), ["tnx_level", "tnx_chg_1d"])
        names += ["tnx_level", "tnx_chg_1d"]
    wide = wide.select("symbol", "date", *names, target)
    return wide.na.drop("any") if drop else wide

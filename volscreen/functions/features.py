"""Feature and target columns over one ordered window a symbol."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

HAR_WINDOWS = (1, 5, 21)
EPSILON = 1e-8


def by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def log_ratio(n: int) -> Column:
    """ln(close / close n rows ago); null where a price is not positive."""
    now, then = F.col("close"), F.lag("close", n).over(by_date())
    return F.when((now > 0) & (then > 0), F.ln(now / then))


def rolling(x: Column, fn, n: int, first: int | None = None, last: int = 0) -> Column:
    """An aggregate that is null until its frame holds n non-null values."""
    frame = by_date().rowsBetween(-(n - 1) if first is None else first, last)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def returns() -> dict[str, Column]:
    return {"ret_1d": F.col("r"), "ret_5d": log_ratio(5)}


def har() -> dict[str, Column]:
    return {f"rv_cc_{n}d": F.sqrt(rolling(F.col("r") * F.col("r"), F.sum, n)) for n in HAR_WINDOWS}


def ranges() -> dict[str, Column]:
    x = F.try_divide(F.col("high") - F.col("low"), F.col("close"))
    return {"range_1d": x, "range_5d_mean": rolling(x, F.avg, 5)}


def volume() -> dict[str, Column]:
    v = F.col("volume")
    sd = rolling(v, F.stddev_samp, 21)
    return {"volume_z_21d": F.try_divide(v - rolling(v, F.avg, 21), F.when(sd != 0, sd))}


def bipower_variation(n: int) -> Column:
    """pi / 2 times the sum of products of absolute returns of neighbouring rows of an n-row window."""
    return F.pi() / 2 * rolling(F.abs("r") * F.abs("r_lag"), F.sum, max(n - 1, 1))


def bipower() -> dict[str, Column]:
    """Bipower volatility, robust to jumps; not of the core families."""
    return {f"bpv_trail_{n}d": F.sqrt(bipower_variation(n)) for n in HAR_WINDOWS}


def jumps() -> dict[str, Column]:
    out = {}
    for n in HAR_WINDOWS:
        rv = rolling(F.col("r") * F.col("r"), F.sum, n)
        bpv = bipower_variation(n)
        out[f"jump_prop_{n}d"] = (
            F.when(rv > 0, F.when(bpv.isNotNull(), F.greatest(rv - bpv, F.lit(0.0)) / rv)).when(rv == 0, F.lit(0.0))
        )
    return out


FAMILIES = {"returns": returns, "har": har, "range": ranges, "volume": volume, "jump": jumps, "bipower": bipower}


def register(name: str, family) -> None:
    """Add a family: a function that gives columns by name, over bars with ``r`` (log return) and ``r_lag``."""
    if name in FAMILIES:
        raise ValueError(f"{name} is a family already")
    FAMILIES[name] = family


CORE = ("returns", "har", "range", "volume")


def forward_volatility(h: int) -> Column:
    """The label: realized volatility of the h rows that follow."""
    if h < 1:
        raise ValueError("the horizon must be at least 1")
    return F.sqrt(rolling(F.col("r") * F.col("r"), F.sum, h, 1, h))


def implied_daily(level: Column) -> Column:
    return level / 100 / F.sqrt(F.lit(252.0))


def implied_minus_realized() -> dict[str, Column]:
    implied = implied_daily(F.col("vix_level"))
    out = {"vix_vol_daily": implied}
    out |= {f"vix_minus_rv_{n}d": implied - F.col(f"rv_cc_{n}d") for n in HAR_WINDOWS}
    return out | {"vix_rv_ratio_5d": F.when(F.col("rv_cc_5d") > 0, implied / F.col("rv_cc_5d"))}


def qlike_loss(y: Column, pred: Column, epsilon: float = EPSILON) -> Column:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    f = F.greatest(pred, F.lit(epsilon))
    return F.ln(f * f) + y * y / (f * f)

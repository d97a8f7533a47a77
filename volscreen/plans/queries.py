"""Queries over bars made of the orders table, and the SQL to compare them with.

A symbol is an order priority; its bar of a day has the day's first and last order prices, the
extremes and the number of orders.  The orders of status P give the auxiliary series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volscreen.functions import features as fx
from volscreen.operators import evaluate as ev
from volscreen.operators import features as ft
from volscreen.operators import folds as fd
from volscreen.operators import forest as rf
from volscreen.operators import models as md
from volscreen.operators import validate as va
from volscreen.sources.bars import bars_of

PLACES, HORIZON, SPLITS = 8, 5, 5


def _r(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded, so that summing in another order gives equal values."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, PLACES).alias(c) if kinds[c] == "double" else F.col(c) for c in (keep or df.columns)])


def bars(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return bars_of(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def aux(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'")
    b = bars_of(o, F.lit("VIX"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))
    return b.withColumn("close", F.col("close") / 10000)


def _family(*names: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        m = ft.feature_matrix(bars(spark, d), HORIZON, names, drop=False)
        return _r(m.drop(f"target_rv_cc_{HORIZON}d"))

    return query


def target(spark, d):
    return _r(ft.feature_matrix(bars(spark, d), HORIZON, ("returns",), drop=False), "symbol", "date", "target_rv_cc_5d")


def matrix(spark, d, horizon: int = HORIZON) -> DataFrame:
    return ft.feature_matrix(bars(spark, d), horizon, vix=aux(spark, d), iv_rv=True)


def folds(spark, d) -> DataFrame:
    return fd.expanding_folds(matrix(spark, d), SPLITS, HORIZON)


def panel(spark, d, models=None) -> DataFrame:
    f = folds(spark, d)
    return md.forecasts(f, models or md.race_models(f.columns), HORIZON)


def _forecast(*models: str):
    return lambda spark, d: _r(panel(spark, d, list(models)))


def _panel_to(*steps):
    def query(spark, d):
        df = panel(spark, d)
        for s in steps:
            df = s(df)
        return _r(df)

    return query


def _simple(then):
    """A step over the panel of the two forecasters that SQL can restate."""

    def query(spark, d):
        return _r(then(panel(spark, d, ["historical_mean", "vix_as_forecast"])))

    return query


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The race with inference of every symbol."""
    return ev.summary_with_inference(panel(spark, d), HORIZON)


def multi_horizon(spark, d):
    out = None
    for h in fd.HORIZONS:
        embargo, block, _ = fd.settings(h)
        f = fd.expanding_folds(matrix(spark, d, h), SPLITS, embargo)
        one = ev.summarize(ev.fold_metrics(md.forecasts(f, md.race_models(f.columns), h))).withColumn("horizon_days", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return _r(out)


def screen_batch(spark, d):
    """One row a symbol: its best model, its QLIKE and its top feature."""
    f = folds(spark, d)
    best = ev.summarize(ev.fold_metrics(md.forecasts(f, md.race_models(f.columns), HORIZON)))
    best = best.groupBy("symbol").agg(F.min_by("model", F.struct("qlike", "model")).alias("best_model"), F.min("qlike").alias("best_qlike"))
    top = ev.rank_features(ev.permutation_importance(f, horizon=HORIZON))
    top = top.groupBy("symbol").agg(F.max_by("feature", F.struct("median_importance", "feature")).alias("top_feature"))
    return _r(best.join(top, "symbol"))


def ranking(spark, d):
    return _r(ev.rank_features(ev.permutation_importance(folds(spark, d), horizon=HORIZON)))


def rates_matrix(spark, d) -> DataFrame:
    m = ft.feature_matrix(bars(spark, d), HORIZON, ("returns",), rates=aux(spark, d), drop=False)
    return _r(m, "symbol", "date", "tnx_level", "tnx_chg_1d")


def broken_report(spark, d) -> DataFrame:
    """The report of bars that have been broken: nulls, negative volumes, wrong extremes and days that come twice."""
    b, day = bars(spark, d), F.dayofmonth("date")
    b = b.withColumns({
        "close": F.when(day != 3, F.col("close")), "volume": F.when(day == 5, -F.col("volume")).otherwise(F.col("volume")),
        "high": F.when(day == 7, F.col("low") - 1).otherwise(F.col("high")), "low": F.when(day == 9, F.col("high") + 1).otherwise(F.col("low")),
    })
    return va.bar_report(b.unionByName(b.where(day == 11)))


_RANKED = ("ret_1d", "rv_cc_5d", "range_1d", "volume_z_21d")


def ranking_of_means(spark, d) -> DataFrame:
    """The ranking of a table that SQL can make: a feature's importance in a fold is its mean over the fold's test rows."""
    f = folds(spark, d).where("role = 'test'").groupBy("symbol", "fold_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in _RANKED])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), F.col(c).alias("importance")) for i, c in enumerate(_RANKED)]))
    return _r(ev.rank_features(f.select("symbol", "fold_id", each.alias("x")).select("symbol", "fold_id", "x.*"), 2))


def _base(df: DataFrame) -> DataFrame:
    return ev.differentials(df, "historical_mean")


# --- SQL ----------------------------------------------------------------------------------

_BARS = """bars AS (
  SELECT upper(trim(o_orderpriority)) AS symbol, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL)"""
_RET = _BARS + """,
ret AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(close / lag(close, 5) OVER w) AS r5,
               (high - low) / nullif(close, 0) AS rng
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
lagged AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY date) AS rl FROM ret)"""


def _roll(x: str, fn: str, n: int, first: int | None = None, last: str = "CURRENT ROW") -> str:
    begin = f"{n - 1} PRECEDING" if first is None else f"{first} FOLLOWING"
    over = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {begin} AND {last})"
    return f"CASE WHEN count({x}) {over} = {n} THEN {fn}({x}) {over} END"


_COLS = {
    "returns": {"ret_1d": "r", "ret_5d": "r5"},
    "har": {f"rv_cc_{n}d": f"sqrt({_roll('r * r', 'sum', n)})" for n in (1, 5, 21)},
    "range": {"range_1d": "rng", "range_5d_mean": _roll("rng", "avg", 5)},
    "volume": {"volume_z_21d": f"(volume - {_roll('volume', 'avg', 21)}) / nullif({_roll('volume', 'stddev_samp', 21)}, 0)"},
    "jump": {},
    "bipower": {f"bpv_trail_{n}d": f"sqrt(pi() / 2 * ({_roll('abs(r) * abs(rl)', 'sum', max(n - 1, 1))}))" for n in (1, 5, 21)},
}
for _n in (1, 5, 21):
    _rv, _bp = _roll("r * r", "sum", _n), _roll("abs(r) * abs(rl)", "sum", max(_n - 1, 1))
    _COLS["jump"][f"jump_prop_{_n}d"] = (
        f"CASE WHEN ({_rv}) > 0 THEN CASE WHEN ({_bp}) IS NOT NULL THEN greatest(({_rv}) - pi() / 2 * ({_bp}), 0) / ({_rv}) END "
        f"WHEN ({_rv}) = 0 THEN 0.0 END"
    )
_TARGET = f"sqrt({_roll('r * r', 'sum', HORIZON, 1, f'{HORIZON} FOLLOWING')})"


def _family_sql(*names: str) -> str:
    cols = {k: v for n in names for k, v in _COLS[n].items()}
    return f"WITH {_RET} SELECT symbol, date, " + ", ".join(f"round({v}, {PLACES}) AS {k}" for k, v in cols.items()) + " FROM lagged"


_CORE = ", ".join(f"{v} AS {k}" for n in fx.CORE for k, v in _COLS[n].items())
_MATRIX = _RET + f""",
vb AS (SELECT CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) / 10000 AS close
       FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
vix AS (SELECT date, close AS vix_level, close / lag(close) OVER (ORDER BY date) - 1 AS vix_chg_1d FROM vb),
core AS (SELECT symbol, date, {_CORE}, {_TARGET} AS target FROM lagged),
wide AS (SELECT c.*, v.vix_level, v.vix_chg_1d, v.vix_level / 100 / sqrt(252.0) AS vix_vol_daily FROM core c ASOF LEFT JOIN vix v ON c.date >= v.date),
iv AS (SELECT *, vix_vol_daily - rv_cc_1d AS vix_minus_rv_1d, vix_vol_daily - rv_cc_5d AS vix_minus_rv_5d,
              vix_vol_daily - rv_cc_21d AS vix_minus_rv_21d, CASE WHEN rv_cc_5d > 0 THEN vix_vol_daily / rv_cc_5d END AS vix_rv_ratio_5d FROM wide),
matrix AS (SELECT * FROM iv WHERE COLUMNS(*) IS NOT NULL)"""
_NAMES = [k for n in fx.CORE for k in _COLS[n]] + [
    "vix_level", "vix_chg_1d", "vix_vol_daily", "vix_minus_rv_1d", "vix_minus_rv_5d", "vix_minus_rv_21d", "vix_rv_ratio_5d"
]
_FOLDS = _MATRIX + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM matrix),
stepped AS (SELECT *, n // {SPLITS + 1} AS s FROM placed),
cut AS (SELECT *, n - ({SPLITS} - fold_id) * s AS b FROM stepped, (SELECT unnest(range({SPLITS})) AS fold_id)
        WHERE s >= 1 AND n - {SPLITS} * s - {HORIZON} >= 1),
folds AS (SELECT *, CASE WHEN pos < b - {HORIZON} THEN 'train' WHEN pos >= b AND pos < b + s THEN 'test' END AS role
          FROM cut WHERE pos < b - {HORIZON} OR (pos >= b AND pos < b + s))"""
_PANEL = _FOLDS + """,
tr AS (SELECT symbol, fold_id, avg(target) AS m, regr_slope(target, vix_vol_daily) AS sl, regr_intercept(target, vix_vol_daily) AS ic
       FROM folds WHERE role = 'train' GROUP BY ALL),
panel AS (
  SELECT symbol, 'historical_mean' AS model, fold_id, date, target AS y_true, m AS y_pred FROM folds JOIN tr USING (symbol, fold_id) WHERE role = 'test'
  UNION ALL
  SELECT symbol, 'vix_as_forecast', fold_id, date, target, greatest(ic + sl * vix_vol_daily, 1e-8) FROM folds JOIN tr USING (symbol, fold_id) WHERE role = 'test'),
lossy AS (SELECT *, ln(greatest(y_pred, 1e-8) ** 2) + y_true ** 2 / greatest(y_pred, 1e-8) ** 2 AS qlike_loss FROM panel)"""
_DIFF = _PANEL + """,
diff AS (SELECT c.symbol, c.model, c.date, c.qlike_loss - b.qlike_loss AS d FROM lossy c JOIN lossy b USING (symbol, date)
         WHERE b.model = 'historical_mean' AND c.model <> 'historical_mean')"""
_MEANS = f"round(avg(qlike_loss), {PLACES}) AS qlike, round(avg((y_true - y_pred) ** 2), {PLACES}) AS mse, round(avg(abs(y_true - y_pred)), {PLACES}) AS mae"
_REGIME_LIST = (("full_sample", "0001-01-01", "9999-12-31"), ("first_half", "1992-01-01", "1996-12-31"), ("before_all", "1900-01-01", "1900-12-31"))


def _rounded(names, extra="") -> str:
    return extra + ", ".join(f"round({n}, {PLACES}) AS {n}" for n in names)


QUERIES = {
    "bars": lambda s, d: bars(s, d),
    "bar_report": lambda s, d: va.bar_report(bars(s, d)),
    "features_returns": _family("returns"),
    "features_har": _family("har"),
    "features_range": _family("range"),
    "features_volume": _family("volume"),
    "features_jump": _family("jump"),
    "target_forward_rv": target,
    "feature_matrix": lambda s, d: _r(matrix(s, d)),
    "folds": lambda s, d: folds(s, d).select("symbol", "date", "fold_id", "role"),
    "fold_sizes": lambda s, d: fd.fold_sizes(folds(s, d)),
    "forecast_mean_and_implied": _forecast("historical_mean", "vix_as_forecast"),
    "forecast_ewma": _forecast("ewma"),
    "forecast_ou": _forecast("ou_rv"),
    "forecast_har": _forecast("har_rv_ols"),
    "fit_status": lambda s, d: md.fit_status(folds(s, d), ["historical_mean", "ou_rv", "ewma_recursive"], HORIZON),
    "features_bipower": _family("bipower"),
    "features_rates": rates_matrix,
    "bar_report_broken": broken_report,
    "ranking_of_means": ranking_of_means,
    "qlike_losses": _simple(ev.with_losses),
    "fold_metrics": _simple(ev.fold_metrics),
    "summary": _simple(lambda p: ev.summarize(ev.fold_metrics(p))),
    "regimes": _simple(lambda p: ev.regime_metrics(p, _REGIME_LIST[1:])),
    "best_by_regime": _simple(lambda p: ev.best_by_regime(ev.regime_metrics(p, _REGIME_LIST[1:2]))),
    "loss_differential": _simple(_base),
    "non_overlapping": _simple(lambda p: ev.non_overlapping(_base(p), HORIZON)),
    "diebold_mariano": _simple(lambda p: ev.diebold_mariano(_base(p), HORIZON)),
    "race": _panel_to(ev.fold_metrics, ev.summarize),
    "race_with_inference": lambda s, d: _r(flagship(s, d)),
    "bootstrap_nonoverlap": _panel_to(ev.differentials, lambda x: ev.non_overlapping(x, HORIZON), lambda x: ev.bootstrap(x, 15)),
    "factor_ranking": ranking,
    "forecast_forest": _forecast("random_forest"),
    "forest_importance": lambda s, d: _r(rf.forest_importance(folds(s, d), HORIZON)),
    "multi_horizon": multi_horizon,
    "screen_batch": screen_batch,
}

ORACLE_SQL = {
    "bars": f"WITH {_BARS} SELECT * FROM bars",
    "bar_report": f"""WITH {_BARS} SELECT symbol, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null_rows, CAST(0 AS BIGINT) AS n_duplicate_days,
        count(*) FILTER (volume < 0) AS n_negative_volume, count(*) FILTER (high < greatest(open, close, low)) AS n_high_too_low,
        count(*) FILTER (low > least(open, close, high)) AS n_low_too_high FROM bars GROUP BY symbol""",
    **{f"features_{n}": _family_sql(n) for n in _COLS},
    "target_forward_rv": f"WITH {_RET} SELECT symbol, date, round({_TARGET}, {PLACES}) AS target_rv_cc_5d FROM lagged",
    "feature_matrix": f"WITH {_MATRIX} SELECT symbol, date, {_rounded(_NAMES)}, round(target, {PLACES}) AS target_rv_cc_5d FROM matrix",
    "folds": f"WITH {_FOLDS} SELECT symbol, date, CAST(fold_id AS INTEGER) AS fold_id, role FROM folds",
    "fold_sizes": f"""WITH {_FOLDS} SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, count(*) FILTER (role = 'train') AS train_size,
        count(*) FILTER (role = 'test') AS test_size FROM folds GROUP BY ALL""",
    "forecast_mean_and_implied": f"WITH {_PANEL} SELECT symbol, model, CAST(fold_id AS INTEGER) AS fold_id, date, {_rounded(['y_true', 'y_pred'])} FROM panel",
    "forecast_ewma": f"""WITH {_FOLDS}, t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, fold_id) AS m FROM folds
        WHERE role = 'train' WINDOW w AS (PARTITION BY symbol, fold_id ORDER BY date)),
        lv AS (SELECT symbol, fold_id, sum(target * CASE WHEN i = 1 THEN power(0.94, m - 1) ELSE 0.06 * power(0.94, m - i) END) AS y_pred FROM t GROUP BY ALL)
        SELECT symbol, 'ewma' AS model, CAST(fold_id AS INTEGER) AS fold_id, date, round(target, {PLACES}) AS y_true, round(y_pred, {PLACES}) AS y_pred
        FROM folds JOIN lv USING (symbol, fold_id) WHERE role = 'test'""",
    "forecast_ou": f"""WITH {_FOLDS}, t AS (SELECT symbol, fold_id, date, ln(target) AS x, lag(ln(target)) OVER (PARTITION BY symbol, fold_id ORDER BY date) AS xl
        FROM folds WHERE role = 'train' AND target > 0),
        c AS (SELECT symbol, fold_id, regr_intercept(x, xl) AS a, greatest(-0.999, least(0.999, regr_slope(x, xl))) AS phi, max_by(x, date) AS xt FROM t GROUP BY ALL)
        SELECT symbol, 'ou_rv' AS model, CAST(fold_id AS INTEGER) AS fold_id, date, round(target, {PLACES}) AS y_true,
               round(greatest(exp(a / (1 - phi) + phi ** {HORIZON} * (xt - a / (1 - phi))), 1e-8), {PLACES}) AS y_pred
        FROM folds JOIN c USING (symbol, fold_id) WHERE role = 'test'""",
    "qlike_losses": f"WITH {_PANEL} SELECT symbol, model, CAST(fold_id AS INTEGER) AS fold_id, date, {_rounded(['y_true', 'y_pred', 'qlike_loss'])} FROM lossy",
    "fold_metrics": f"WITH {_PANEL} SELECT symbol, model, CAST(fold_id AS INTEGER) AS fold_id, {_MEANS}, count(*) AS test_size FROM lossy GROUP BY symbol, model, fold_id",
    "summary": f"""WITH {_PANEL}, f AS (SELECT symbol, model, fold_id, avg(qlike_loss) AS qlike, avg((y_true - y_pred) ** 2) AS mse, avg(abs(y_true - y_pred)) AS mae
        FROM lossy GROUP BY ALL) SELECT symbol, model, round(avg(qlike), {PLACES}) AS qlike, round(avg(mse), {PLACES}) AS mse, round(avg(mae), {PLACES}) AS mae FROM f GROUP BY ALL""",
    "regimes": f"""WITH {_PANEL}, g(regime, a, b) AS (VALUES {', '.join(f"('{r}', DATE '{a}', DATE '{b}')" for r, a, b in _REGIME_LIST)}),
        k AS (SELECT DISTINCT symbol, model FROM lossy)
        SELECT k.symbol, g.regime, k.model, count(l.date) AS n_obs, {_MEANS} FROM k CROSS JOIN g
        LEFT JOIN lossy l ON l.symbol = k.symbol AND l.model = k.model AND l.date BETWEEN g.a AND g.b GROUP BY ALL""",
    "best_by_regime": f"""WITH {_PANEL}, g(regime, a, b) AS (VALUES {', '.join(f"('{r}', DATE '{a}', DATE '{b}')" for r, a, b in _REGIME_LIST[:2])}),
        m AS (SELECT symbol, regime, model, avg(qlike_loss) AS q FROM lossy JOIN g ON date BETWEEN a AND b GROUP BY ALL)
        SELECT symbol, regime, arg_min(model, q) AS best_model, round(min(q), {PLACES}) AS qlike FROM m GROUP BY ALL""",
    "loss_differential": f"WITH {_DIFF} SELECT symbol, model, date, round(d, {PLACES}) AS d FROM diff",
    "non_overlapping": f"""WITH {_DIFF}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY date) - 1 AS i FROM diff)
        SELECT symbol, model, date, round(d, {PLACES}) AS d FROM i WHERE i % {HORIZON} = 0""",
    "diebold_mariano": f"""WITH {_DIFF}, x AS (SELECT *, d - avg(d) OVER (PARTITION BY symbol, model) AS x FROM diff),
        l AS (SELECT *, {', '.join(f'x * lag(x, {k}) OVER w AS p{k}' for k in range(1, HORIZON))} FROM x WINDOW w AS (PARTITION BY symbol, model ORDER BY date)),
        v AS (SELECT symbol, model, count(*) AS n_obs, avg(d) AS mean_diff,
              (sum(x * x) + {' + '.join(f'2 * (1 - {k} / {HORIZON}.0) * coalesce(sum(p{k}), 0)' for k in range(1, HORIZON))}) / count(*) AS v FROM l GROUP BY ALL),
        q AS (SELECT *, CASE WHEN v > 0 AND n_obs >= 2 THEN mean_diff / sqrt(v / n_obs) END AS dm,
              (n_obs + 1 - {2 * HORIZON} + {HORIZON * (HORIZON - 1)} / n_obs) / n_obs AS f FROM v)
        SELECT symbol, model, n_obs, round(mean_diff, {PLACES}) AS mean_diff, round(dm, {PLACES}) AS dm,
               round(CASE WHEN f >= 0 THEN dm * sqrt(f) END, {PLACES}) AS hln FROM q""",
}

_X = ("rv_cc_1d", "rv_cc_5d", "rv_cc_21d")
_COV = ", ".join(f"covar_pop({_X[i]}, {_X[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"covar_pop({x}, target) AS t{i}, avg({x}) AS m{i}" for i, x in enumerate(_X))


def _minor(a: str, b: str, c: str, d: str) -> str:
    return f"({a} * {d} - {b} * {c})"


def _det(m: list[list[str]]) -> str:
    return " + ".join(f"{s}{m[0][j]} * {_minor(m[1][k], m[1][l], m[2][k], m[2][l])}" for s, j, k, l in (("", 0, 1, 2), ("-", 1, 0, 2), ("", 2, 0, 1)))


_C = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_SLOPES = ", ".join(f"({_det([[f't{i}' if k == j else _C[i][k] for k in range(3)] for i in range(3)])}) / ({_det(_C)}) AS b{j}" for j in range(3))
ORACLE_SQL |= {
    "forecast_har": f"""WITH {_FOLDS}, g AS (SELECT symbol, fold_id, avg(target) AS my, {_COV} FROM folds WHERE role = 'train' GROUP BY ALL),
        s AS (SELECT *, {_SLOPES} FROM g)
        SELECT symbol, 'har_rv_ols' AS model, CAST(fold_id AS INTEGER) AS fold_id, date, round(target, {PLACES}) AS y_true,
               round(greatest(my + {' + '.join(f'b{i} * ({x} - m{i})' for i, x in enumerate(_X))}, 1e-8), {PLACES}) AS y_pred
        FROM folds JOIN s USING (symbol, fold_id) WHERE role = 'test'""",
    "fit_status": f"""WITH {_FOLDS}, g AS (SELECT symbol, fold_id, count(*) AS n, count(*) FILTER (target > 0) AS p FROM folds WHERE role = 'train' GROUP BY ALL),
        m(model, least) AS (VALUES ('historical_mean', 1), ('ou_rv', 30), ('ewma_recursive', 30)),
        h AS (SELECT *, CASE WHEN model = 'ou_rv' THEN p ELSE n END AS have FROM g CROSS JOIN m)
        SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, model, n AS n_train,
               CASE WHEN have >= least THEN 'ok' ELSE 'skipped_too_short: ' || have || ' of ' || least END AS status FROM h""",
    "features_rates": f"""WITH {_RET}, vb AS (SELECT CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) / 10000 AS close
        FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
        t AS (SELECT date, close AS tnx_level, close / lag(close) OVER (ORDER BY date) - 1 AS tnx_chg_1d FROM vb)
        SELECT l.symbol, l.date, {_rounded(['tnx_level', 'tnx_chg_1d'])} FROM lagged l ASOF LEFT JOIN t ON l.date >= t.date""",
    "bar_report_broken": f"""WITH {_BARS}, b AS (SELECT symbol, date, open, CASE WHEN day(date) = 7 THEN low - 1 ELSE high END AS high,
        CASE WHEN day(date) = 9 THEN high + 1 ELSE low END AS low, CASE WHEN day(date) <> 3 THEN close END AS close,
        CASE WHEN day(date) = 5 THEN -volume ELSE volume END AS volume FROM bars),
        a AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE day(date) = 11)
        SELECT symbol, count(*) AS n_rows, count(*) FILTER (close IS NULL) AS n_null_rows,
        count(DISTINCT date) FILTER (day(date) = 11) AS n_duplicate_days, count(*) FILTER (volume < 0) AS n_negative_volume,
        count(*) FILTER (high < greatest(open, close, low)) AS n_high_too_low, count(*) FILTER (low > least(open, close, high)) AS n_low_too_high FROM a GROUP BY symbol""",
    "ranking_of_means": f"""WITH {_FOLDS}, i AS ({' UNION ALL '.join(f"SELECT symbol, fold_id, '{c}' AS feature, {i} AS pos, round(avg({c}), 6) AS importance FROM folds WHERE role = 'test' GROUP BY symbol, fold_id" for i, c in enumerate(_RANKED))}),
        p AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold_id ORDER BY importance DESC, pos) AS place FROM i)
        SELECT symbol, feature, round(avg(importance), {PLACES}) AS mean_importance, round(median(importance), {PLACES}) AS median_importance,
        round(coalesce(stddev_samp(importance), 0), {PLACES}) AS std_importance, count(*) AS n_folds,
        round(count(*) FILTER (place <= 2) / count(*), {PLACES}) AS top_k_hit_rate FROM p GROUP BY symbol, feature""",
}

#: Queries with a date; both sides give it as text.
_DATED = [k for k in ORACLE_SQL if "date" in ORACLE_SQL[k].rsplit("SELECT", 1)[1].split("FROM")[0] or k == "bars"]
_DATED = [k for k in _DATED if k not in ("regimes", "bar_report_broken")]


def _as_text(query):
    return lambda spark, d: query(spark, d).withColumn("date", F.col("date").cast("string"))


for _k in _DATED:
    QUERIES[_k] = _as_text(QUERIES[_k])
    ORACLE_SQL[_k] = f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({ORACLE_SQL[_k]})"

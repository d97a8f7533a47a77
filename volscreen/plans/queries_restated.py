"""Further queries with SQL: raw bars normalized, stored tables read again, penalized and recursive fits, p-values."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volscreen.operators import evaluate as ev
from volscreen.operators import folds as fd
from volscreen.operators import models as md
from volscreen.operators import validate as va
from volscreen.plans import queries as q
from volscreen.plans import screen
from volscreen.sources import artifacts, scratch
from volscreen.sources import bars as source

_TARGET = f"target_rv_cc_{q.HORIZON}d"


def _raw(bars: DataFrame, close: str) -> list:
    """Columns as vendors give them: text, padded and mixed names, times within the day."""
    text = [F.col(c).cast("string").alias(n) for c, n in (("open", "Open"), ("high", " HIGH"), ("low", "Low "), ("close", close))]
    volume = F.when(F.dayofmonth("date") != 3, F.col("volume")).cast("string").alias("VOLUME")
    stamp = F.concat(F.col("date").cast("string"), F.lit(" 16:00:00")).alias("Date")
    return [F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("Symbol"), stamp, *text, volume]


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """A plain close beats an adjusted one, the first of equal names stays, rows without a volume go."""
    b = q.bars(spark, d)
    return va.normalize_bars(b.select(*_raw(b, "Close"), F.lit("0").alias("Adj Close"), F.lit("1").alias("close ")))


def normalized_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Without a plain close the adjusted one stands for it."""
    b = q.bars(spark, d)
    return va.normalize_bars(b.select(*_raw(b, "Adj-Close")))


def stored_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars stored by symbol and read again: two symbols, an inclusive range of days."""
    root = scratch.scratch_path(spark, "bars")
    source.write_bars(q.bars(spark, d), root)
    return source.read_bars(spark, root, [" 1-urgent", "5-LOW"], "1993-03-01", "1996-02-29")


def stored_matrix(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.scratch_path(spark, "matrix")
    artifacts.write_matrix(q.matrix(spark, d), root, q.HORIZON)
    return q._r(artifacts.read_matrix(spark, root, q.HORIZON))


def stored_losses(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample losses kept as JSON records and read again; NaN and infinities come back as null."""
    p = q._r(ev.with_losses(q.panel(spark, d, ["historical_mean", "vix_as_forecast"])))
    day = F.dayofmonth("date")
    p = p.withColumn("y_pred", F.when(day == 1, float("nan")).when(day == 2, float("inf")).otherwise(F.col("y_pred")))
    with tempfile.TemporaryDirectory() as root:
        kept = artifacts.ArtifactStore(root)
        kept.write_json("losses", "oos", p)
        rows = kept.read_json("losses", "oos")
    fields = "symbol string, model string, fold_id int, date string, y_true double, y_pred double, qlike_loss double"
    return spark.createDataFrame([tuple(r[n.split()[0]] for n in fields.split(", ")) for r in rows], fields)


def _fold_columns(*features: str):
    return lambda spark, d: q.folds(spark, d).select("symbol", "date", "fold_id", "role", _TARGET, *features)


_three, _one = _fold_columns(*md.HAR), _fold_columns("rv_cc_5d")


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    c = md.coefficients(_three(spark, d), "ridge", q.HORIZON)
    return q._r(c.withColumn("feature", F.coalesce("feature", F.lit("intercept"))))


def fold_sizes_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    """The same matrix cut with the embargo of every horizon."""
    m, out = q.matrix(spark, d).select("symbol", "date"), None
    for h in fd.HORIZONS:
        one = fd.fold_sizes(fd.expanding_folds(m, q.SPLITS, fd.settings(h)[0])).withColumn("horizon_days", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


def p_values(spark: SparkSession, d: str) -> DataFrame:
    dm = ev.diebold_mariano(q._base(q.panel(spark, d, ["historical_mean", "vix_as_forecast"])), q.HORIZON)
    return q._r(ev.with_p_value(dm), "symbol", "model", "hln_p_value")


def bootstrap_status(spark: SparkSession, d: str) -> DataFrame:
    """What the bootstrap says of series of which some are shorter than a block (the first year's)."""
    diffs = q._base(q.panel(spark, d, ["historical_mean", "vix_as_forecast"]))
    diffs = diffs.withColumn("model", F.concat("model", F.lit(" "), F.year("date")))
    return q._r(ev.bootstrap(diffs, 200, 19), "symbol", "model", "n_obs", "mean_diff", "status")


def _ingested(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    root = scratch.scratch_path(spark, "market")
    return screen.ingest(q.bars(spark, d).unionByName(q.aux(spark, d)), root), root


def _days(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


def _symbols(spark: SparkSession, d: str) -> list[str]:
    return [r.symbol for r in q.bars(spark, d).select("symbol").distinct().collect()]  # names of series


def built_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Bars ingested, matrices built from the store and kept."""
    market = _ingested(spark, d)[1]
    kept = scratch.scratch_path(spark, "matrices")
    return _days(screen.build_matrices(spark, market, kept, _symbols(spark, d), q.HORIZON, screen.Extras.parse(" IV_RV, vix")))


def baseline_experiment(spark: SparkSession, d: str) -> DataFrame:
    """The plain baselines over a stored matrix."""
    root = scratch.scratch_path(spark, "matrix")
    artifacts.write_matrix(q.matrix(spark, d), root, q.HORIZON)
    made = artifacts.read_matrix(spark, root, q.HORIZON, _symbols(spark, d))
    return q._r(screen.baseline_experiment(made, q.HORIZON, q.SPLITS)["metrics"])


QUERIES = {
    "ingested_bars": lambda s, d: _days(_ingested(s, d)[0]),
    "built_matrices": built_matrices,
    "baseline_experiment": baseline_experiment,
    "normalized_bars": normalized,
    "normalized_adjusted_bars": normalized_adjusted,
    "stored_bars": stored_bars,
    "stored_matrix": stored_matrix,
    "stored_losses": stored_losses,
    "forecast_ridge": lambda s, d: q._r(md.forecasts(_three(s, d), ["ridge"], q.HORIZON)),
    "forecast_soft_threshold": lambda s, d: q._r(md.forecasts(_one(s, d), ["lasso", "elasticnet"], q.HORIZON)),
    "forecast_ewma_recursive": q._forecast("ewma_recursive"),
    "ridge_coefficients": coefficients,
    "fold_sizes_by_horizon": fold_sizes_by_horizon,
    "dm_p_values": p_values,
    "bootstrap_status": bootstrap_status,
}

# --- SQL ----------------------------------------------------------------------------------

_NORMALIZED = f"WITH {q._BARS} SELECT symbol, date, open, high, low, close, volume FROM bars WHERE day(date) <> 3"
_RIDGE_C = [[f"c{min(i, j)}{max(i, j)}" + (" * (1 + 1.0 / n)" if i == j else "") for j in range(3)] for i in range(3)]
_RIDGE_SLOPES = ", ".join(
    f"({q._det([[f't{i}' if k == j else _RIDGE_C[i][k] for k in range(3)] for i in range(3)])}) / ({q._det(_RIDGE_C)}) AS b{j}" for j in range(3)
)
_RIDGE = f"""{q._FOLDS},
g AS (SELECT symbol, fold_id, count(*) AS n, avg(target) AS my, {q._COV} FROM folds WHERE role = 'train' GROUP BY ALL),
s AS (SELECT *, {_RIDGE_SLOPES} FROM g)"""
_TESTED = f"CAST(fold_id AS INTEGER) AS fold_id, date, round(target, {q.PLACES}) AS y_true, round(greatest({{y}}, 1e-8), {q.PLACES}) AS y_pred"
_GRID = ", ".join(f"({g})" for g in md.GRID)

_BASELINES = " UNION ALL ".join(
    f"SELECT symbol, model, fold_id, y_true, y_pred FROM ({q.ORACLE_SQL[k]})".replace(f", {q.PLACES})", ", 17)")
    + (" WHERE model = 'historical_mean'" if k == "forecast_mean_and_implied" else "")
    for k in ("forecast_mean_and_implied", "forecast_ewma", "forecast_har")
)
_SPAN = "count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date"

ORACLE_SQL = {
    "ingested_bars": f"""WITH {q._BARS} SELECT symbol, {_SPAN} FROM bars GROUP BY symbol
        UNION ALL SELECT 'VIX', count(DISTINCT o_orderdate), CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR), CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR)
        FROM orders WHERE o_orderstatus = 'P'""",
    "built_matrices": f"WITH {q._MATRIX} SELECT symbol, {_SPAN} FROM matrix GROUP BY symbol",
    "baseline_experiment": f"""WITH l AS ({_BASELINES}),
        f AS (SELECT symbol, model, fold_id, avg(ln(greatest(y_pred, 1e-8) ** 2) + y_true ** 2 / greatest(y_pred, 1e-8) ** 2) AS qlike,
              avg((y_true - y_pred) ** 2) AS mse, avg(abs(y_true - y_pred)) AS mae FROM l GROUP BY ALL)
        SELECT symbol, model, round(avg(qlike), {q.PLACES}) AS qlike, round(avg(mse), {q.PLACES}) AS mse, round(avg(mae), {q.PLACES}) AS mae FROM f GROUP BY ALL""",
    "normalized_bars": _NORMALIZED,
    "normalized_adjusted_bars": _NORMALIZED,
    "stored_bars": f"""WITH {q._BARS} SELECT symbol, date, open, high, low, close, volume FROM bars
        WHERE symbol IN ('1-URGENT', '5-LOW') AND date BETWEEN DATE '1993-03-01' AND DATE '1996-02-29'""",
    "stored_matrix": f"WITH {q._MATRIX} SELECT symbol, date, {q._rounded(q._NAMES)}, round(target, {q.PLACES}) AS {_TARGET} FROM matrix",
    "stored_losses": f"""WITH {q._PANEL} SELECT symbol, model, CAST(fold_id AS INTEGER) AS fold_id, date, round(y_true, {q.PLACES}) AS y_true,
        CASE WHEN day(date) > 2 THEN round(y_pred, {q.PLACES}) END AS y_pred, round(qlike_loss, {q.PLACES}) AS qlike_loss FROM lossy""",
    "forecast_ridge": f"""WITH {_RIDGE} SELECT symbol, 'ridge' AS model,
        {_TESTED.format(y='my + ' + ' + '.join(f'b{i} * ({x} - m{i})' for i, x in enumerate(q._X)))}
        FROM folds JOIN s USING (symbol, fold_id) WHERE role = 'test'""",
    "ridge_coefficients": f"""WITH {_RIDGE}, a(pos, feature) AS (VALUES (-1, 'intercept'), (0, '{q._X[0]}'), (1, '{q._X[1]}'), (2, '{q._X[2]}'))
        SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, feature, CAST(pos AS INTEGER) AS pos,
        round(CASE pos WHEN -1 THEN my - b0 * m0 - b1 * m1 - b2 * m2 WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END, {q.PLACES}) AS coefficient FROM s CROSS JOIN a""",
    "forecast_soft_threshold": f"""WITH {q._FOLDS}, p(model, l1, l2) AS (VALUES ('lasso', 0.001, 0.0), ('elasticnet', 0.0005, 0.0005)),
        g AS (SELECT symbol, fold_id, avg(target) AS my, avg(rv_cc_5d) AS mx, stddev_pop(rv_cc_5d) AS sd, covar_pop(rv_cc_5d, target) / stddev_pop(rv_cc_5d) AS m
              FROM folds WHERE role = 'train' GROUP BY ALL),
        s AS (SELECT *, sign(m) * greatest(abs(m) - l1, 0) / (1 + l2) / sd AS slope FROM g CROSS JOIN p)
        SELECT symbol, model, {_TESTED.format(y='my + slope * (rv_cc_5d - mx)')} FROM folds JOIN s USING (symbol, fold_id) WHERE role = 'test'""",
    "forecast_ewma_recursive": f"""WITH RECURSIVE {q._FOLDS}, e(decay) AS (VALUES {_GRID}),
        t AS MATERIALIZED (SELECT symbol, fold_id, target, row_number() OVER (PARTITION BY symbol, fold_id ORDER BY date) AS i FROM folds WHERE role = 'train'),
        u AS MATERIALIZED (SELECT symbol, fold_id, date, target, rv_cc_1d AS v, row_number() OVER (PARTITION BY symbol, fold_id ORDER BY date) AS i FROM folds WHERE role = 'test'),
        lv AS (SELECT symbol, fold_id, i, CAST(decay AS DOUBLE) AS decay, target AS level, CAST(0 AS DOUBLE) AS loss FROM t CROSS JOIN e WHERE i = 1
               UNION ALL SELECT t.symbol, t.fold_id, t.i, decay, decay * level + (1 - decay) * target, loss + (target - level) ** 2
               FROM lv JOIN t ON t.symbol = lv.symbol AND t.fold_id = lv.fold_id AND t.i = lv.i + 1),
        z AS (SELECT symbol, fold_id, max(i) AS i FROM t GROUP BY ALL),
        best AS MATERIALIZED (SELECT symbol, fold_id, decay, level FROM lv JOIN z USING (symbol, fold_id, i)
                 QUALIFY row_number() OVER (PARTITION BY symbol, fold_id ORDER BY loss, decay) = 1),
        f AS (SELECT symbol, fold_id, CAST(0 AS BIGINT) AS i, decay, level FROM best
              UNION ALL SELECT u.symbol, u.fold_id, u.i, decay, decay * level + (1 - decay) * v
              FROM f JOIN u ON u.symbol = f.symbol AND u.fold_id = f.fold_id AND u.i = f.i + 1)
        SELECT symbol, 'ewma_recursive' AS model, {_TESTED.format(y='level')} FROM f JOIN u USING (symbol, fold_id, i)""",
    "fold_sizes_by_horizon": f"""WITH {q._MATRIX}, h(horizon_days, e) AS (VALUES (1, 1), (5, 5), (21, 21)),
        c AS (SELECT symbol, count(*) AS n, count(*) // {q.SPLITS + 1} AS s FROM matrix GROUP BY symbol)
        SELECT symbol, CAST(k AS INTEGER) AS fold_id, n - ({q.SPLITS} - k) * s - e AS train_size, s AS test_size, CAST(horizon_days AS INTEGER) AS horizon_days
        FROM c CROSS JOIN h CROSS JOIN (SELECT unnest(range({q.SPLITS})) AS k) WHERE s >= 1 AND n - {q.SPLITS} * s - e >= 1""",
    "dm_p_values": f"""WITH s AS ({q.ORACLE_SQL['diebold_mariano'].replace(f'dm * sqrt(f) END, {q.PLACES})', 'dm * sqrt(f) END, 15)')}),
        i AS (SELECT unnest(range(4001)) AS i),
        p AS (SELECT symbol, model, n_obs - 1 AS k, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
              * (1 + (abs(hln) * i / 4000) ** 2 / (n_obs - 1)) ** (-n_obs / 2.0)) * any_value(abs(hln)) / 12000 AS area FROM s CROSS JOIN i GROUP BY symbol, model, hln, n_obs)
        SELECT symbol, model, round(1 - 2 * area * exp(lgamma((k + 1) / 2.0) - lgamma(k / 2.0)) / sqrt(k * pi()), {q.PLACES}) AS hln_p_value FROM p""",
    "bootstrap_status": f"""WITH {q._DIFF}, y AS (SELECT symbol, model || ' ' || year(date) AS model, d FROM diff)
        SELECT symbol, model, count(*) AS n_obs, round(avg(d), {q.PLACES}) AS mean_diff,
        CASE WHEN count(*) < 200 THEN 'skipped_too_short' ELSE 'ok' END AS status FROM y GROUP BY symbol, model""",
}

for _k in QUERIES:
    if _k not in ("ridge_coefficients", "fold_sizes_by_horizon", "dm_p_values", "bootstrap_status", "ingested_bars", "built_matrices", "baseline_experiment"):
        QUERIES[_k] = q._as_text(QUERIES[_k])
        ORACLE_SQL[_k] = f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({ORACLE_SQL[_k]})"

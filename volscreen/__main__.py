"""The command line: ``python -m volscreen COMMAND``."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from volscreen.operators import folds as fd
from volscreen.operators import validate as va
from volscreen.plans import screen as sc
from volscreen.sources import artifacts as store
from volscreen.sources import bars as source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="volscreen", description=__doc__)
    p.add_argument("--market", default="data/raw", help="folder of stored bars")
    p.add_argument("--matrices", default="data/processed", help="folder of feature matrices")
    p.add_argument("--artifacts", default="artifacts", help="folder of experiments")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info", help="folders and stored experiments")
    c = sub.add_parser("ingest", help="check raw bars and store them")
    c.add_argument("path", help="CSV, or Parquet if it ends so")
    c.add_argument("--symbol", help="the symbol of a table without such a column")
    c.add_argument("--start")
    c.add_argument("--end")
    for name, text in (
        ("features", "build feature matrices"), ("evaluate", "the plain baselines"), ("screen", "race, inference and rankings"),
        ("screen-batch", "a screen of several symbols"), ("screen-horizons", "screens of several horizons"), ("run", "matrices and their screen"),
    ):
        c = sub.add_parser(name, help=text)
        c.add_argument("symbols", help="symbols, parted by commas")
        c.add_argument("--with", dest="extras", default="", help=f"of {', '.join(sc.EXTRAS)}")
        c.add_argument("--splits", type=int, default=5)
        c.add_argument("--experiment", default=f"{name}-{date.today():%Y%m%d}")
        if name == "screen-horizons":
            c.add_argument("--horizons", default=",".join(map(str, fd.HORIZONS)))
        else:
            c.add_argument("--horizon", type=int, default=5)
            c.add_argument("--embargo", type=int)
            c.add_argument("--block", type=int)
        c.add_argument("--shapley", action="store_true", help="importance by a random forest as well")
        c.add_argument("--skip-features", action="store_true", help="use the matrices that are stored")
    return p


def names(text: str) -> list[str]:
    found = list(dict.fromkeys(t.strip().upper() for t in text.split(",") if t.strip()))
    if not found:
        raise ValueError("no symbols")
    return found


def show(rows: list[dict]) -> None:
    if rows:
        print("\t".join(rows[0]))
    for r in rows:
        print("\t".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r.values()))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    kept = store.ArtifactStore(a.artifacts)
    if a.command == "info":
        print(f"market\t{a.market}\nmatrices\t{a.matrices}\nartifacts\t{a.artifacts}")
        show([{"experiment": e} for e in kept.experiments()])
        return
    if a.command == "ingest":
        raw = spark.read.parquet(a.path) if a.path.rstrip("/").endswith(".parquet") else source.read_csv_bars(spark, a.path)
        bars = va.normalize_bars(raw, a.symbol)
        for bound, keep in ((a.start, lambda d, x: d >= x), (a.end, lambda d, x: d <= x)):
            if bound:
                bars = bars.where(keep(bars["date"], date.fromisoformat(bound)))
        show(store.records(sc.ingest(bars, a.market)))
        return
    symbols, extras = names(a.symbols), sc.Extras.parse(a.extras)
    if a.command == "screen-horizons":
        horizons = [int(h) for h in a.horizons.split(",")]
        if not a.skip_features:
            for h in horizons:
                sc.build_matrices(spark, a.market, a.matrices, symbols, h, extras)
        options = sc.Screen(n_splits=a.splits, shapley=a.shapley)
        show(sc.screen_horizons(spark, a.matrices, symbols, kept, a.experiment, horizons, options))
        return
    options = sc.Screen(a.horizon, a.splits, a.embargo, a.block, shapley=a.shapley)
    if a.command == "features":
        show(store.records(sc.build_matrices(spark, a.market, a.matrices, symbols, a.horizon, extras)))
    elif a.command == "evaluate":
        tables = sc.baseline_experiment(store.read_matrix(spark, a.matrices, a.horizon, symbols), a.horizon, a.splits, a.embargo)
        for name, table in tables.items():
            kept.write_json(a.experiment, name, table)
        show(kept.read_json(a.experiment, "metrics"))
    elif a.command == "screen":
        show(sc.screen(store.read_matrix(spark, a.matrices, a.horizon, symbols), kept, a.experiment, options)["metrics"])
    else:
        show(sc.study(spark, a.market, a.matrices, kept, a.experiment, symbols, options, extras, a.skip_features))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("volscreen").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

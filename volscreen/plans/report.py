"""Memos of a screen as HTML with bars drawn in SVG; plain functions over result rows."""

from __future__ import annotations

import math
from html import escape

# The wording of a gap to the baseline.
BASELINE_TEXT = "baseline (reference)"
SIGNIFICANT_TEXT = "significantly lower mean OOS QLIKE vs HAR (bootstrap)"
LOWER_TEXT = "lower mean OOS QLIKE vs HAR (not significant at α)"
HIGHER_TEXT = "higher mean OOS QLIKE vs HAR (not significant at α)"
SIMILAR_TEXT = "similar mean OOS QLIKE vs HAR"

TOP = 20
PARAMETRIC = ("ou_rv", "ewma_recursive")
STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto}td,th{padding:.2em .8em;text-align:right}td:first-child,th:first-child{text-align:left}"


def gap_wording(row: dict) -> str:
    gap = row.get("mean_diff")
    if gap is None or math.isnan(gap):
        return BASELINE_TEXT
    if gap == 0:
        return SIMILAR_TEXT
    if gap > 0:
        return HIGHER_TEXT
    return SIGNIFICANT_TEXT if row.get("significant_vs_baseline") else LOWER_TEXT


def _cell(value) -> str:
    if value is None:
        return "–"
    return f"{value:.6g}" if isinstance(value, float) else escape(str(value))


def html_table(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>" if rows else "<p>none</p>"


def percentile(values: list[float], share: float) -> float:
    """Linear between order statistics."""
    ordered = sorted(values)
    at = share * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (at - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low])


def top_features(ranking: list[dict], key: str = "median_importance") -> list[dict]:
    """The first TOP rows by importance, drawn no longer than twice the 95th percentile."""
    rows = [r for r in ranking if r.get(key) is not None]
    rows = sorted(rows, key=lambda r: -r[key])[:TOP]
    if not rows:
        return []
    most = 2 * percentile([r[key] for r in rows], 0.95)
    return [{"feature": r["feature"], "value": r[key], "drawn": min(r[key], most) if most > 0 else r[key]} for r in rows]


def importance_svg(ranking: list[dict]) -> str:
    rows = top_features(ranking)
    if not rows:
        return "<p>none</p>"
    scale = max(max(abs(r["drawn"]) for r in rows), 1e-300)
    bars = "".join(
        f'<text x="190" y="{22 * i + 15}" text-anchor="end">{escape(r["feature"])}</text>'
        f'<rect x="200" y="{22 * i + 3}" width="{380 * max(r["drawn"], 0) / scale:.1f}" height="16" fill="#4a6fa5"/>'
        f'<text x="{205 + 380 * max(r["drawn"], 0) / scale:.1f}" y="{22 * i + 15}">{r["value"]:.4g}</text>'
        for i, r in enumerate(rows)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="680" height="{22 * len(rows) + 6}" font-size="12">{bars}</svg>'


def implied_rows(models: list[dict], ranking: list[dict]) -> tuple[list[dict], list[dict]]:
    """The implied forecaster's row and the first three factors of implied minus realized volatility."""
    gaps = [r for r in ranking if r["feature"].startswith("vix_minus_rv_")]
    return [r for r in models if r["model"] == "vix_as_forecast"], gaps[:3]


def best_by_regime(regimes: list[dict]) -> list[dict]:
    """The model of the least QLIKE of each window in the order given; none where the window is empty."""
    best: dict[str, dict] = {}
    for r in regimes:
        kept = best.setdefault(r["regime"], {"regime": r["regime"], "model": None, "qlike": None})
        if r["qlike"] is not None and (kept["qlike"] is None or r["qlike"] < kept["qlike"]):
            kept.update(model=r["model"], qlike=r["qlike"])
    return list(best.values())


def _page(title: str, sections: list[tuple[str, str]]) -> str:
    body = "".join(f"<h2>{escape(h)}</h2>{b}" for h, b in sections)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def screen_memo(symbol: str, tables: dict[str, list[dict]], meta: dict) -> str:
    models, ranking = tables["metrics"], tables["factor_ranking"]
    worded = [r | {"against_baseline": gap_wording(r)} for r in models]
    implied, gaps = implied_rows(models, ranking)
    method = html_table([{"option": k, "value": v} for k, v in meta.items()], ["option", "value"])
    columns = ["model", "qlike", "mse", "mae"]
    return _page(
        f"Volatility screen: {symbol}",
        [
            ("Question", f"<p>Which forecasts of {escape(str(meta['target']))} beat {escape(str(meta['baseline']))} out of sample?</p>"),
            ("Method", method),
            ("Race", html_table(worded, [*columns, "mean_diff", "p_value", "hln_p_value", "against_baseline"])),
            ("Factors", html_table(ranking[:TOP], ["feature", "median_importance", "mean_importance", "std_importance", "top_k_hit_rate"])),
            ("Importance", importance_svg(ranking)),
            ("Implied and realized volatility", html_table(implied, columns) + html_table(gaps, ["feature", "median_importance"])),
            ("Parametric models", html_table([r for r in models if r["model"] in PARAMETRIC], columns)),
            ("Windows", html_table(best_by_regime(tables["metrics_by_regime"]), ["regime", "model", "qlike"])),
            ("Caveats", "<p>Past losses on daily bars; no costs, and a gap that is not significant may be chance.</p>"),
        ],
    )


def horizons_memo(rows: list[dict]) -> str:
    worded = [r | {"against_baseline": gap_wording(r)} for r in rows]
    parts = [
        (f"{h} days", html_table([r for r in worded if r["horizon_days"] == h], ["symbol", "model", "qlike", "mean_diff", "p_value", "against_baseline"]))
        for h in sorted({r["horizon_days"] for r in rows})
    ]
    return _page("Skill by horizon", parts)

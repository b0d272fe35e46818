"""Reports of a dataset's metrics as JSON and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from tidemark.plans.evaluation import metrics_dict
from tidemark.sources.local import save_json, save_text


def html_report(metrics: dict, preview: list[dict]) -> str:
    """A page of cards, a bar for each category, lengths and a preview. All text is escaped, and no outside script is used."""
    esc = lambda x: html.escape(str(x))
    card = lambda k, v: f"<div class='card'><b>{esc(k)}</b><span>{esc(f'{v:.3f}' if isinstance(v, float) else v)}</span></div>"
    cards = "".join(card(k, metrics[k]) for k in ("total", "knowledge_mean", "quality_mean", "unique_ratio", "reasoning_rate", "synthesis_rate") if metrics.get(k) is not None)
    most = max([1, *metrics["categories"].values()])
    bars = "".join(f"<tr><td>{esc(k)}</td><td><div class='bar' style='width:{300 * v // most}px'></div></td><td>{v}</td></tr>" for k, v in metrics["categories"].items())
    lengths = "".join(f"<tr><td>{t}</td>" + "".join(f"<td>{esc(metrics.get(f'{t}_length_{e}'))}</td>" for e in ("mean", "min", "max")) + "</tr>" for t in ("instruction", "output"))
    rows = "".join("<tr>" + "".join(f"<td>{esc((r.get(k) or '')[:100])}</td>" for k in ("id", "category", "instruction", "output")) + "</tr>" for r in preview)
    return (
        "<!doctype html><meta charset='utf-8'><title>Quality report</title><style>body{font:14px sans-serif;margin:2em}.card{display:inline-block;margin:.5em;padding:1em;border:1px solid #ccc}"
        ".card span{display:block;font-size:1.6em}.bar{height:12px;background:#468}td,th{padding:.2em .6em;text-align:left}</style>"
        f"<h1>Quality report</h1>{cards}<h2>Categories</h2><table>{bars}</table><h2>Lengths</h2><table><tr><th></th><th>mean</th><th>min</th><th>max</th></tr>{lengths}</table>"
        f"<h2>Preview</h2><table><tr><th>id</th><th>category</th><th>instruction</th><th>output</th></tr>{rows}</table>"
    )


def write_reports(df: DataFrame, report_path: str, metrics_path: str) -> dict:
    metrics = metrics_dict(df)
    preview = [r.asDict(recursive=True) for r in df.orderBy("_ord").limit(10).collect()]
    save_json(metrics_path, metrics)
    save_text(report_path, html_report(metrics, preview))
    return metrics

"""A graph document as one self-contained HTML page (an SVG without scripts)."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame, functions as F

#: What one page can show; a larger graph is cut to its strongest edges, which the page says.
MAX_EDGES = 400


def to_html(document: DataFrame, max_edges: int = MAX_EDGES) -> str:
    """Nodes on a circle, edges as arrows; nodes with gaps are red."""
    total = document.select(F.size("edges")).first()[0]
    edges = document.select(F.explode("edges").alias("e")).select("e.cause", "e.effect", "e.avg_confidence").orderBy(F.desc("avg_confidence"), "cause", "effect").limit(max_edges).collect()
    names = sorted({n for e in edges for n in (e.cause, e.effect)})
    gaps = {r.variable for r in document.select(F.explode("gaps").alias("g")).select("g.variable").filter(F.col("variable").isin(names)).distinct().collect()} if names else set()
    size = 400 + 12 * len(names)
    radius = size / 2 - 90
    at = {n: (size / 2 + radius * math.cos(2 * math.pi * i / len(names)), size / 2 + radius * math.sin(2 * math.pi * i / len(names))) for i, n in enumerate(names)}
    lines = []
    for e in edges:
        (x1, y1), (x2, y2) = at[e.cause], at[e.effect]
        lines.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#666" stroke-opacity="{0.2 + 0.8 * e.avg_confidence:.2f}" marker-end="url(#a)"><title>{html.escape(e.cause)} → {html.escape(e.effect)} ({e.avg_confidence:.2f})</title></line>')
    dots = [f'<g><circle cx="{x:.1f}" cy="{y:.1f}" r="7" fill="{"#c0392b" if n in gaps else "#2980b9"}"/><text x="{x + 9:.1f}" y="{y + 4:.1f}">{html.escape(n)}</text></g>' for n, (x, y) in at.items()]
    note = f"{len(edges)} of {total} edges; nodes with gaps are red"
    marker = '<defs><marker id="a" viewBox="0 0 10 10" refX="18" refY="5" markerWidth="6" markerHeight="6" orient="auto"><path d="M0 0L10 5L0 10z" fill="#666"/></marker></defs>'
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Causal graph</title></head><body><p>{note}</p><svg width="{size}" height="{size}" font-family="sans-serif" font-size="11">{marker}{"".join(lines)}{"".join(dots)}</svg></body></html>'

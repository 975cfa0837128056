"""Plots of small results as SVG text: bars of a histogram, lines by size."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_W, _H, _M = 640, 400, 48  # of the picture, and its margins


def _frame(title: str, body: list[str], x: tuple[float, float], y: tuple[float, float]) -> str:
    show = lambda v: f"{v:.4g}"
    axes = [
        f'<line x1="{_M}" y1="{_H - _M}" x2="{_W - _M}" y2="{_H - _M}" stroke="black"/>', f'<line x1="{_M}" y1="{_M}" x2="{_M}" y2="{_H - _M}" stroke="black"/>',
        f'<text x="{_M}" y="{_H - _M + 16}">{show(x[0])}</text>', f'<text x="{_W - _M}" y="{_H - _M + 16}" text-anchor="end">{show(x[1])}</text>',
        f'<text x="{_M - 4}" y="{_H - _M}" text-anchor="end">{show(y[0])}</text>', f'<text x="{_M - 4}" y="{_M + 10}" text-anchor="end">{show(y[1])}</text>',
    ]
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{_W}" height="{_H}" font-family="sans-serif" font-size="11">', f'<text x="{_W / 2}" y="24" text-anchor="middle" font-size="14">{escape(title)}</text>', *axes, *body, "</svg>"]) + "\n"


def _rows(df: DataFrame, order: list[str], most: int) -> list:
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no plot")
    return rows


def histogram_svg(bins: DataFrame, title: str, most: int = 1000) -> str:
    """Bars of (bin, lo, hi, n). No bins give an empty frame; more than ``most`` raise ``ValueError``."""
    rows = _rows(bins, ["bin"], most)
    if not rows:
        return _frame(title, [], (0, 1), (0, 1))
    lo, hi, top = rows[0]["lo"], rows[-1]["hi"], max(max(r["n"] for r in rows), 1)
    at = lambda v: _M + (v - lo) / ((hi - lo) or 1) * (_W - 2 * _M)
    body = []
    for r in rows:
        h = r["n"] / top * (_H - 2 * _M)
        body.append(f'<rect x="{at(r["lo"]):.1f}" y="{_H - _M - h:.1f}" width="{max(at(r["hi"]) - at(r["lo"]) - 1, 0.5):.1f}" height="{h:.1f}" fill="steelblue"/>')
    return _frame(title, body, (lo, hi), (0, top))


def lines_svg(points: DataFrame, title: str, x: str = "size", y: str = "value", by: str = "metric", most: int = 10_000) -> str:
    """A line for each value of ``by`` over ``x``; rows with nulls are left out, more than ``most`` raise ``ValueError``."""
    rows = _rows(points.where(f"`{x}` is not null and `{y}` is not null").select(by, x, y), [by, x], most)
    if not rows:
        return _frame(title, [], (0, 1), (0, 1))
    xs, ys = [float(r[x]) for r in rows], [float(r[y]) for r in rows]
    (x0, x1), (y0, y1) = (min(xs), max(xs)), (min(ys), max(ys))
    px, py = (lambda v: _M + (v - x0) / ((x1 - x0) or 1) * (_W - 2 * _M)), (lambda v: _H - _M - (v - y0) / ((y1 - y0) or 1) * (_H - 2 * _M))
    colours, body = ("steelblue", "darkorange", "seagreen", "firebrick", "purple", "grey"), []
    for k, name in enumerate(dict.fromkeys(r[by] for r in rows)):
        path = " ".join(f"{px(float(r[x])):.1f},{py(float(r[y])):.1f}" for r in rows if r[by] == name)
        c = colours[k % len(colours)]
        body += [f'<polyline points="{path}" fill="none" stroke="{c}" stroke-width="2"/>', f'<text x="{_W - _M + 4}" y="{_M + 14 * k}" fill="{c}">{escape(str(name))}</text>']
    return _frame(title, body, (x0, x1), (y0, y1))

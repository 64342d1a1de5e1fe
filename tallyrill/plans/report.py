"""Reports: results as sections, sections as a page. Sections hold bounded results, so they live on the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.operators.tabular import positioned

# The words that a status cell is known by, its mark, four themes, and the colour of a mark in them.
GOOD = ["pass", "ok", "true", "yes", "active", "found"]
BAD = ["fail", "error", "false", "no", "closed", "not found"]
DOUBTFUL = ["warning", "pending", "unknown", "mismatch"]
MARKS = {"pass": "✅", "fail": "❌", "warn": "⚠️"}
THEMES = {
    "dark": {"bg": "#0f0f23", "cardBg": "#1a1a2e", "text": "#e0e0e0", "heading": "#ffffff", "accent": "#00d4ff", "accent2": "#7c3aed", "border": "#2a2a4a", "tableBg": "#16162a", "tableStripe": "#1e1e38", "success": "#22c55e", "warning": "#f59e0b", "error": "#ef4444"},
    "light": {"bg": "#f8fafc", "cardBg": "#ffffff", "text": "#334155", "heading": "#0f172a", "accent": "#2563eb", "accent2": "#7c3aed", "border": "#e2e8f0", "tableBg": "#ffffff", "tableStripe": "#f1f5f9", "success": "#16a34a", "warning": "#d97706", "error": "#dc2626"},
    "blue": {"bg": "#0c1222", "cardBg": "#131d35", "text": "#cbd5e1", "heading": "#f1f5f9", "accent": "#38bdf8", "accent2": "#818cf8", "border": "#1e3a5f", "tableBg": "#0f1a2e", "tableStripe": "#152238", "success": "#34d399", "warning": "#fbbf24", "error": "#f87171"},
    "green": {"bg": "#0a1612", "cardBg": "#0f2318", "text": "#d1d5db", "heading": "#f0fdf4", "accent": "#4ade80", "accent2": "#2dd4bf", "border": "#1a3a2a", "tableBg": "#0d1f16", "tableStripe": "#132e1f", "success": "#22c55e", "warning": "#fbbf24", "error": "#f87171"},
}
COLOURS = {"pass": "success", "fail": "error", "warn": "warning"}
EMPTY = "No data provided."


def status_class(c: Column) -> Column:
    """pass, fail, warn or null, by the word alone, case aside."""
    low = F.lower(c)
    return F.when(low.isin(GOOD), "pass").when(low.isin(BAD), "fail").when(low.isin(DOUBTFUL), "warn")


def stripe(position: Column) -> Column:
    """0 or 1 for the row's place from 1."""
    return F.pmod(position - 1, F.lit(2))


def table_section(df: DataFrame, heading: str = "Data", most: int = 1000) -> dict:
    """All rows of a result (in the order it has) as a table section; more than ``most`` raise, as the section is held on the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table section holds {most} rows at most; write larger results with section_rows")
    return {"heading": heading, "type": "table", "data": [r.asDict(recursive=True) for r in rows]}


def build_sections(source: object = None, sections: list[dict] | None = None) -> list[dict]:
    """Sections given, then those of the source: a list is a table, an object with ``sections`` brings its own, another object is key and value."""
    out = list(sections or [])
    if isinstance(source, str):
        source = json.loads(source)
    if isinstance(source, DataFrame):
        out.append(table_section(source))
    elif isinstance(source, list):
        out.append({"heading": "Data", "type": "table", "data": source})
    elif isinstance(source, dict):
        out += source["sections"] if source.get("sections") else [{"heading": "Summary", "type": "key-value", "data": source}]
    return out or [{"heading": "Report", "body": EMPTY}]


def _shown(v: object) -> str:
    return "" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else str(v)


def _cell(v: object, theme: dict) -> str:
    word = v.lower() if isinstance(v, str) else None
    kind = "pass" if word in GOOD else "fail" if word in BAD else "warn" if word in DOUBTFUL else None
    text = html.escape(_shown(v))
    return f'<span style="color:{theme[COLOURS[kind]]};font-weight:600">{MARKS[kind]} {text}</span>' if kind else text


def render_section(section: dict, theme: str = "light") -> str:
    """A section as HTML, cell values escaped; a table's columns are the keys of all its rows, in order of appearance."""
    t, kind, body = THEMES[theme], section.get("type"), ""
    if kind == "table" and section.get("data"):
        rows = section["data"]
        keys = list(dict.fromkeys(k for r in rows for k in r))
        head = "".join(f"<th>{html.escape(k)}</th>" for k in keys)
        lines = "".join(f'<tr style="background:{t["tableStripe"] if i % 2 else t["tableBg"]}">' + "".join(f"<td>{_cell(r.get(k), t)}</td>" for k in keys) + "</tr>" for i, r in enumerate(rows))
        body = f"<table><thead><tr>{head}</tr></thead><tbody>{lines}</tbody></table>"
    elif kind == "key-value" and section.get("data"):
        body = "<dl>" + "".join(f"<dt>{html.escape(k)}</dt><dd>{html.escape(_shown(v))}</dd>" for k, v in section["data"].items()) + "</dl>"
    elif kind == "list" and isinstance(section.get("items"), list):
        body = "<ul>" + "".join(f"<li>{html.escape(_shown(i))}</li>" for i in section["items"]) + "</ul>"
    elif section.get("body"):
        body = "<p>" + html.escape(section["body"]).replace("\n", "<br>") + "</p>"
    return f'<section><h2>{html.escape(section.get("heading") or "Section")}</h2>{body}</section>'


def render_html(sections: list[dict], title: str, author: str, date: str, theme: str = "light") -> str:
    t = THEMES[theme]
    style = f"body{{background:{t['bg']};color:{t['text']};font-family:sans-serif;margin:2em}}h1,h2{{color:{t['heading']}}}h2{{border-left:4px solid {t['accent']};padding-left:8px}}dt{{color:{t['accent2']};font-weight:600}}section{{background:{t['cardBg']};border:1px solid {t['border']};padding:1em;margin:1em 0}}table{{border-collapse:collapse}}td,th{{padding:4px 10px;text-align:left;border:1px solid {t['border']}}}"
    parts = "".join(render_section(s, theme) for s in sections)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><p>{html.escape(author)}, {html.escape(date)}</p>{parts}</body></html>'


def accessibility_sections(facts: dict, rows: DataFrame) -> list[dict]:
    """The summary, then the violations where there are any."""
    table = table_section(rows, "Violations")
    return [{"heading": "Audit Summary", "type": "key-value", "data": facts}, *([table] if table["data"] else [])]


def section_rows(df: DataFrame, heading: str, order: list[str], per_range: int = 1_000_000) -> DataFrame:
    """A result as rows ``heading, position, parity, cells``, without bringing it to the driver or to one task."""
    cells = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    placed = positioned(df, order, per_range)
    return placed.select(F.lit(heading).alias("heading"), F.col("_position").alias("position"), stripe(F.col("_position")).cast("int").alias("parity"), cells.alias("cells"))

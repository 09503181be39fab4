"""Report sinks: Markdown, CSV, HTML and JSON of aggregate tables."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame


def _rows(table: DataFrame) -> tuple[list[str], list[list]]:
    """An aggregate with a row for each strategy or tier."""
    return table.columns, [list(r) for r in table.collect()]


def _shown(v) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def markdown(title: str, table: DataFrame) -> str:
    head, rows = _rows(table)
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(map(_shown, r)) + " |" for r in rows)]) + "\n"


def as_csv(table: DataFrame) -> str:
    head, rows = _rows(table)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([head, *rows])
    return out.getvalue()


def as_html(title: str, table: DataFrame) -> str:
    head, rows = _rows(table)
    cells = lambda tag, r: "".join(f"<{tag}>{html.escape(_shown(v))}</{tag}>" for v in r)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows)
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{cells('th', head)}</tr>{body}</table></body></html>"


def as_json(table: DataFrame) -> str:
    head, rows = _rows(table)
    return json.dumps([dict(zip(head, r)) for r in rows], default=str, indent=1)

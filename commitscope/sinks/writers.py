"""Reports as JSON, CSV, text tables and HTML pages; a catalog of texts with ``{{parameter}}`` places.

A report is a small ranked table, so its writer collects it; ``write_parquet`` is the way for large results.
"""

from __future__ import annotations

import csv
import datetime as dt
import html
import io
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame

GROUPED = {"patterns", "commit_velocity", "commit_size", "branches", "health"}
TEXTS: dict[str, str] = {"shown": "({{shown}} of {{total}} shown; use --top to change)", "no_data": "(no data)", "title": "Repository analysis", "generated": "Generated {{at}}"}


def read_texts(path: str) -> None:
    """Adds the texts of a JSON file, ``code -> text``, to the catalog; they replace those of the same codes."""
    TEXTS.update(json.loads(Path(path).read_text(encoding="utf-8")))


def text(code: str, **parameters: object) -> str:
    """The catalog's text of a code with its parameters put in; a code that it lacks stands for itself."""
    out = TEXTS.get(code, code)
    for k, v in parameters.items():
        out = out.replace("{{" + k + "}}", str(v))
    return out


def title(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in name.split("_"))


@dataclass
class Report:
    """A report's rows: ``columns`` after the key ``name``; ``group`` leads where the report has groups."""

    name: str
    columns: list[str]
    rows: list[dict] = field(default_factory=list)
    description: str = ""

    @property
    def grouped(self) -> bool:
        return self.name in GROUPED

    @classmethod
    def of(cls, name: str, df: DataFrame, description: str = "") -> Report:
        key = next((c for c in ("name", "language") if c in df.columns), df.columns[0])
        rows = [r.asDict(recursive=True) for r in df.collect()]
        rows = [{"group": r.pop("group", None), "name": r.pop(key), **r} for r in rows]
        return cls(name, [c for c in df.columns if c not in (key, "group")], rows, description)

    def groups(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in self.rows:
            out.setdefault(str(r["group"]), []).append(r)
        return out


def _plain(v: object) -> object:
    return v.isoformat() if isinstance(v, dt.date) else v


def _entry(row: dict, columns: list[str]) -> dict:
    return {"key": row["name"], "values": {c: _plain(row[c]) for c in sorted(columns) if row.get(c) is not None}}


def as_json(reports: Iterable[Report], top: int | None = None, at: dt.datetime | None = None) -> str:
    """One envelope with every report; ``top`` shortens flat reports only."""
    found = {}
    for r in reports:
        shown = r.rows if r.grouped or top is None else r.rows[:top]
        body = {"name": r.name, "display_name": title(r.name), "description": r.description, "columns": [{"value": c, "label": title(c)} for c in r.columns], "total_entries": len(r.rows), "shown_entries": len(shown)}
        if r.grouped:
            body["entry_groups"] = [{"name": g, "label": title(g), "entries": [_entry(x, r.columns) for x in rows]} for g, rows in r.groups().items()]
        else:
            body["entries"] = [_entry(x, r.columns) for x in shown]
        found[r.name] = body
    stamp = (at or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"generated_at": stamp, "reports": found}, ensure_ascii=False, indent=2)


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(_plain(v))


def as_csv(report: Report, top: int | None = None) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow([*["group"] * report.grouped, "name", *report.columns])
    for r in report.rows if report.grouped or top is None else report.rows[:top]:
        w.writerow([*[r["group"]] * report.grouped, _cell(r["name"]), *(_cell(r.get(c)) for c in report.columns)])
    return out.getvalue()


def csv_paths(out: str, names: list[str]) -> dict[str, Path]:
    """``stem_report.ext`` for each report."""
    p = Path(out)
    return {n: p.with_name(f"{p.stem}_{n}{p.suffix or '.csv'}") for n in names}


def as_table(report: Report, top: int | None = None) -> str:
    lines = [title(report.name), *[report.description] * bool(report.description)]

    def table(rows: list[dict]) -> list[str]:
        cells = [["name", *report.columns], *[[_cell(r["name"]), *(_cell(r.get(c)) for c in report.columns)] for r in rows]]
        wide = [max(map(len, col)) for col in zip(*cells, strict=True)]
        return ["  ".join(x.ljust(n) for x, n in zip(row, wide, strict=True)).rstrip() for row in cells]

    if not report.rows:
        return "\n".join([*lines, text("no_data")])
    if report.grouped:
        for g, rows in report.groups().items():
            lines += ["", title(g), *table(rows)]
        return "\n".join(lines)
    shown = report.rows if top is None else report.rows[:top]
    lines += table(shown)
    if len(shown) < len(report.rows):
        lines.append(text("shown", shown=len(shown), total=len(report.rows)))
    return "\n".join(lines)


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{{TITLE}}</title><style>body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}</style></head>
<body><h1>{{TITLE}}</h1><p>{{GENERATED_AT}}</p><div id="out"></div><script id="data" type="application/json">{{REPORT_DATA_JSON}}</script><script>
for (const r of Object.values(JSON.parse(document.getElementById("data").textContent).reports)) {
  const t = document.createElement("table"), add = (tag, xs) => { const row = t.insertRow(); for (const x of xs) { const c = document.createElement(tag); c.textContent = x ?? ""; row.append(c); } };
  add("th", ["name", ...r.columns.map(c => c.label)]);
  for (const e of r.entries ?? r.entry_groups.flatMap(g => g.entries)) add("td", [e.key, ...r.columns.map(c => e.values[c.value])]);
  const h = document.createElement("h2"); h.textContent = r.display_name; document.getElementById("out").append(h, t);
}
</script></body></html>
"""


def as_html(reports: Iterable[Report], at: dt.datetime | None = None) -> str:
    """One page with all rows; the data cannot end its script element."""
    data = as_json(reports, None, at)
    stamp = json.loads(data)["generated_at"]
    page = PAGE.replace("{{TITLE}}", html.escape(text("title"))).replace("{{GENERATED_AT}}", html.escape(text("generated", at=stamp)))
    return page.replace("{{REPORT_DATA_JSON}}", data.replace("</", "<\\/"))


def write_parquet(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as a table below ``folder``, written by the executors."""
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


class Writer(Protocol):
    """Turns reports into one text, at most ``top`` rows of each."""

    def __call__(self, reports: list[Report], top: int | None = None) -> str: ...


def _csv(reports: list[Report], top: int | None = None) -> str:
    return "".join(f"--- {r.name} ---\n{as_csv(r, top)}" for r in reports)


def _tables(reports: list[Report], top: int | None = None) -> str:
    return "\n\n".join(as_table(r, top) for r in reports)


#: Writers by the name of their format; a caller's own can be added.
WRITERS: dict[str, Writer] = {"table": _tables, "json": as_json, "csv": _csv, "html": lambda reports, top=None: as_html(reports)}

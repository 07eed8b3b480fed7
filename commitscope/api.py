"""``analyze``: named reports over the tables of a repository; and the command line."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import re
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from commitscope.functions import languages
from commitscope.plans import history, tree
from commitscope.scoring.health import whole
from commitscope.sinks import writers
from commitscope.sources import git

#: Report names in their order, and other names that stand for them.
REPORTS = """health branches composition authors hotspots churn ownership coupling patterns age bloat outliers quality complexity construct_churn debt_markers large_sources half_life
succession knowledge_silos fan_in_out module_coupling churn_pareto construct_ownership commit_velocity commit_size doc_coverage dead_code clones test_ratio""".split()
ALIASES = {
    "todo": "debt_markers", "todos": "debt_markers", "big-files": "large_sources", "halflife": "half_life", "silos": "knowledge_silos", "fanio": "fan_in_out", "fan": "fan_in_out", "pareto": "churn_pareto",
    "velocity": "commit_velocity", "commit_anomalies": "commit_size", "docs": "doc_coverage", "documentation": "doc_coverage", "orphans": "dead_code", "unused": "dead_code", "duplicates": "clones", "duplication": "clones",
    "tests": "test_ratio", "branch": "branches",
}
HEAVY = {"half_life"}
#: Reports of the caller's own, by name.
OWN: dict[str, Callable[[Tables, str], DataFrame]] = {}


def report(name: str) -> Callable:
    """Registers a function of (tables, as_of) as a report of its own: ``only`` and the writers then know its name."""

    if name in REPORTS:
        raise ValueError(f"there is a report {name} already")

    def keep(build: Callable[[Tables, str], DataFrame]) -> Callable[[Tables, str], DataFrame]:
        OWN[name] = build
        return build

    return keep


def report_names(only: str | None = None) -> list[str]:
    """The reports that a comma-separated list names; without one all but the heavy ones."""
    if only is None:
        return [r for r in REPORTS if r not in HEAVY] + list(OWN)
    out = []
    for part in filter(None, (x.strip() for x in only.split(","))):
        low = part.lower()
        name = ALIASES.get(low) or ALIASES.get(low.replace("-", "_")) or low.replace("-", "_")
        if name not in REPORTS and name not in OWN:
            raise ValueError(f"Unknown report kind: '{part}'")
        out.append(name)
    if not out:
        raise ValueError("--only requires at least one report kind")
    return out


def parse_duration(s: str) -> int:
    """Days of ``30d``, ``2w``, ``6m`` or ``1y``."""
    s = s.strip()
    if not s:
        raise ValueError("Empty duration string")
    if not re.fullmatch(r"[+-]?\d+", s[:-1]):
        raise ValueError(f"Invalid duration number: '{s[:-1]}'")
    if int(s[:-1]) <= 0:
        raise ValueError(f"Duration must be positive, got {int(s[:-1])}")
    if s[-1] not in "dwmy":
        raise ValueError(f"Unknown duration suffix: '{s[-1]}'. Use d, w, m, or y.")
    return int(s[:-1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[s[-1]]


def time_range(since: str | None, date_from: str | None, date_to: str | None) -> dict:
    """Options of ``history.time_range``; none for the whole history."""
    if since and (date_from or date_to):
        raise ValueError("Cannot combine --since with --from/--to")
    if since:
        return {"since_days": parse_duration(since)}
    if date_from and not date_to:
        raise ValueError("--from requires --to")
    if date_to and not date_from:
        raise ValueError("--to requires --from")
    if date_from:
        days = []
        for flag, x in (("--from", date_from), ("--to", date_to)):
            try:
                days.append(dt.date.fromisoformat(x))
            except ValueError as e:
                raise ValueError(f"Invalid {flag} date: {e}") from e
        if days[0] > days[1]:
            raise ValueError("--from date must be before --to date")
        return {"start": date_from, "end": date_to}
    return {}


def _seconds(span: dict) -> dict:
    """Bounds in epoch seconds, a day wider than the days of ``history.time_range``."""
    day = lambda x: int(dt.datetime.fromisoformat(x).replace(tzinfo=dt.UTC).timestamp())
    if "since_days" in span:
        return {"start": day(span["as_of"]) - (span["since_days"] + 1) * 86_400}
    return {"start": day(span["start"]) - 86_400, "end": day(span["end"]) + 2 * 86_400} if span else {}


class Tables:
    """The tables of one repository, each built when first asked for; ``changes`` and ``head_files`` are cached."""

    def __init__(self, spark: SparkSession, repo: str | None = None, tables: dict[str, DataFrame] | None = None, **span) -> None:
        self.spark, self.repo, self.span, self.held = spark, repo, span, dict(tables or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in ("changes", "constructs", "head_files", "refs", "blame"):
            raise AttributeError(name)
        if name not in self.held:
            if self.repo is None:
                raise ValueError(f"this needs the table {name}")
            if name == "changes":
                # only commits of the days in question are read; the exact range is the report's own filter
                rows = git.changes(self.spark, self.repo, **_seconds(self.span)).cache()
                self.held[name] = history.time_range(rows, **self.span) if self.span else rows
            elif name == "constructs":
                self.held[name] = git.constructs(self.spark, self.repo, self.changes).cache()
            elif name == "blame":
                self.held[name] = git.blame(self.spark, self.repo, tree.aged_paths(self.head_files)).cache()
            else:
                df = getattr(git, name)(self.spark, self.repo)
                self.held[name] = df.cache() if name == "head_files" else df
        return self.held[name]


def build(name: str, t: Tables, as_of: str) -> DataFrame:
    """The lazy plan of one report."""
    if name in OWN:
        return OWN[name](t, as_of)
    if name == "health":
        rest = {n: build(n, t, as_of) for n in REPORTS if n not in HEAVY | {"health"}}
        return whole(rest, git.git_folder(t.repo) if t.repo else None)
    if name in ("authors", "churn", "ownership", "coupling", "module_coupling", "patterns", "outliers", "quality", "churn_pareto", "commit_velocity", "commit_size"):
        return getattr(history, name)(t.changes)
    if name in ("age", "succession", "knowledge_silos"):
        return getattr(history, name)(t.changes, as_of=as_of)
    if name in ("hotspots", "construct_churn", "construct_ownership"):
        return getattr(history, name)(t.changes, t.constructs)
    if name in ("half_life",):
        return tree.half_life(t.blame, as_of, paths=tree.aged_paths(t.head_files) if "head_files" in t.held else None)
    if name == "debt_markers":
        blame = t.blame if t.repo is None else lambda paths: git.blame(t.spark, t.repo, paths)
        return tree.debt_markers(t.head_files, blame, as_of)
    if name == "branches":
        return tree.branches(t.refs, as_of)
    return getattr(tree, name)(t.head_files)


def analyze(spark: SparkSession, source: str | dict[str, DataFrame], only: str | None = None, since: str | None = None, date_from: str | None = None, date_to: str | None = None, as_of: str | None = None) -> dict[str, DataFrame]:
    """Reports by name, lazily planned, over a repository's path or over its tables."""
    names, span = report_names(only), time_range(since, date_from, date_to)
    day = as_of or dt.datetime.now(dt.UTC).date().isoformat()
    if "since_days" in span:
        span["as_of"] = day
    t = Tables(spark, tables=source, **span) if isinstance(source, dict) else Tables(spark, source, **span)
    if isinstance(source, dict) and span and "changes" in t.held:
        t.held["changes"] = history.time_range(t.held["changes"], **span)
    return {n: build(n, t, day) for n in names}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="commitscope", description="Reports over a git repository.")
    p.add_argument("repo", nargs="?", default=".")
    p.add_argument("--only")
    p.add_argument("--since")
    p.add_argument("--from", dest="date_from")
    p.add_argument("--to", dest="date_to")
    p.add_argument("--format", "-f", choices=list(writers.WRITERS), default="table")
    p.add_argument("--output", "-o")
    p.add_argument("--top", type=int)
    p.add_argument("--as-of")
    p.add_argument("--quick-composition", action="store_true")
    p.add_argument("--languages", help="a JSON5 table of more languages")
    p.add_argument("--locale", help="a JSON file of texts by code, or en")
    a = p.parse_args(argv)
    try:
        report_names(a.only), time_range(a.since, a.date_from, a.date_to)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if a.locale and a.locale != "en":
        writers.read_texts(a.locale)
    if not a.quick_composition:
        git.whole(a.repo, lambda: sys.stdin.isatty() and input(f"{a.repo} is a shallow clone; fetch its whole history now? [y/N] ").strip().lower() in ("y", "yes"))
    spark = SparkSession.builder.appName("commitscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.languages:
        languages.use(spark, a.languages)
    if a.quick_composition:
        rows = [r.asDict() for r in tree.quick_composition(git.files_on_disk(spark, a.repo)).limit(a.top or 1 << 30).collect()]  # a row a language
        out = json.dumps(rows, indent=2)
        Path(a.output).write_text(out, encoding="utf-8") if a.output else print(out)
        return 0
    found = analyze(spark, a.repo, a.only, a.since, a.date_from, a.date_to, a.as_of)
    reports = [writers.Report.of(n, df) for n, df in found.items()]
    if a.format == "csv" and a.output:
        for r, path in zip(reports, writers.csv_paths(a.output, [r.name for r in reports]).values(), strict=True):
            path.write_text(writers.as_csv(r, a.top), encoding="utf-8")
        return 0
    out = writers.WRITERS[a.format](reports, a.top)
    if a.output:
        Path(a.output).write_text(out, encoding="utf-8")
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

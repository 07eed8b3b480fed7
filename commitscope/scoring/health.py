"""The health report: pillar and supplementary scores over the other reports, as one lazy plan.

Each input report is reduced to one row of counts; the rows are combined and the scores are arithmetic on them. The
expressions are plain SQL, so that the same texts serve Spark and DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 20
#: What is taken from each report: one-row aggregates by report, with the value of each where the report is missing.
INPUTS: dict[str, dict[str, tuple[str, float]]] = {
    "quality": {x: (f"max(percent) FILTER (WHERE name = '{n}')", 0) for x, n in (("q_short", "short_messages"), ("q_low", "low_quality_messages"), ("q_mega", "mega_commits"), ("q_revert", "revert_commits"), ("q_merge", "merge_commits"))},
    "knowledge_silos": {"at_risk": ("count(*) FILTER (WHERE risk = 'at_risk')", 0)},
    "succession": {"stale_owners": ("count(*) FILTER (WHERE status IN ('orphaned', 'knowledge_transfer_needed'))", 0)},
    "ownership": {"owned": ("count(*)", 0), "owned_well": ("count(*) FILTER (WHERE bus_factor >= 3)", 0), "owned_single": ("count(*) FILTER (WHERE bus_factor <= 1)", 0)},
    "complexity": {"cc_very_high": ("count(*) FILTER (WHERE cyclomatic >= 20)", 0), "cc_high": ("count(*) FILTER (WHERE cyclomatic BETWEEN 11 AND 19)", 0)},
    "outliers": {"outliers": ("count(*)", 0)},
    "debt_markers": {"stale_markers": ("count(*) FILTER (WHERE age_days BETWEEN 180 AND 364)", 0), "rotten_markers": ("count(*) FILTER (WHERE age_days >= 365)", 0)},
    "large_sources": {"huge_sources": ("count(*) FILTER (WHERE code_lines >= 5000)", 0), "big_sources": ("count(*) FILTER (WHERE code_lines BETWEEN 1500 AND 4999)", 0)},
    "bloat": {"bloat": ("count(*) FILTER (WHERE recommendation <> 'ok')", 0)},
    "composition": {"binary_files": ("coalesce(max(files) FILTER (WHERE name = '(binary/skipped)'), 0)", 0)},
    "branches": {
        "refs": ("count(*)", 0), "merged_stale": ("count(*) FILTER (WHERE recommendation = 'merged_stale')", 0),
        "stale_refs": ("count(*) FILTER (WHERE recommendation = 'stale')", 0), "abandoned_refs": ("count(*) FILTER (WHERE recommendation = 'abandoned')", 0),
    },
    "churn": {"added": ("coalesce(sum(lines_added), 0)", 0), "deleted": ("coalesce(sum(lines_deleted), 0)", 0)},
    "churn_pareto": {
        "pareto_files": ("count(*) FILTER (WHERE name <> '<summary>')", 0),
        "pareto_pct": ("max(cumulative_pct) FILTER (WHERE name <> '<summary>' AND rank = greatest(files_here // 5, 1))", 80),
    },
    "coupling": {"tight_pairs": ("count(*) FILTER (WHERE score > 0.7)", 0)},
    "fan_in_out": {"hubs": ("count(*) FILTER (WHERE role = 'hub')", 0), "unstable": ("count(*) FILTER (WHERE instability_pct > 80)", 0)},
    "module_coupling": {"module_pairs": ("count(*)", 0)},
    "authors": {"authors": ("count(*)", 0)},
    "hotspots": {"hot": ("count(*) FILTER (WHERE level = 'file' AND score >= 100)", 0)},
}


def _over(x: str, limit: int) -> str:
    return f"greatest(coalesce({x}, 0) - {limit}, 0)"


_RATIO = "CASE WHEN added > 0 THEN CAST(deleted AS DOUBLE) / added ELSE 0 END"
_WELL, _SINGLE = ("CASE WHEN owned > 0 THEN CAST({x} * 100 AS DOUBLE) / owned ELSE 0 END".format(x=x) for x in ("owned_well", "owned_single"))
#: Scores before clamping.
PILLARS = {
    "commit_discipline": f"100 - ({_over('q_short', 20)} * 1.0 + {_over('q_low', 5)} * 2.0 + {_over('q_mega', 10)} * 1.5 + {_over('q_revert', 3)} * 3.0 + {_over('q_merge', 30)} * 0.5)",
    "bus_factor": f"100 - least(at_risk * 2.0, 50) - least(stale_owners * 1.5, 30) + least(greatest({_WELL} - 60, 0) * 0.125, 5)",
    "refactoring_debt": "100 - (least(cc_very_high * 4.0, 50) + least(cc_high * 1.0, 20) + least(outliers * 0.5, 20) + least(stale_markers * 0.3, 10) + least(rotten_markers * 0.6, 20) + least(huge_sources * 3.0, 15) + least(big_sources * 0.5, 10))",
    "tidiness": f"100 - (least(bloat * 3.0, 60) + least(binary_files * 1.0, 20) + least(merged_stale * 1.5, 15)) + least(greatest(({_RATIO}) - 0.8, 0) * 25, 5)",
    "change_concentration": "CASE WHEN pareto_files < 5 THEN 100 ELSE 100 - 2.0 * greatest(coalesce(pareto_pct, 80) - 80, 0) END",
}
#: Score, and the reports of which one at least must be there.
SUPPLEMENTARY = {
    "architecture": ("100 - (least(tight_pairs * 4.0, 30) + least(hubs * 3.0, 20) + least(unstable * 2.0, 15) + least(module_pairs * 2.0, 15))", ("coupling", "fan_in_out", "module_coupling")),
    "team_health": (f"70 + CASE WHEN authors >= 10 THEN 15 WHEN authors >= 5 THEN 10 WHEN authors >= 3 THEN 5 ELSE 0 END + least(floor({_WELL}) * 0.15, 10) - least(greatest(floor({_SINGLE}) - 50, 0) * 0.5, 25)", ("authors", "ownership")),
    "activity": (f"75 + least(({_RATIO}) * 10, 15) - least(hot * 1.5, 20) + CASE WHEN added + deleted > 1000 THEN 5 ELSE 0 END", ("churn", "hotspots")),
    "branch_hygiene": ("CASE WHEN refs < 2 THEN NULL ELSE 100 - (least(stale_refs * 2.0, 40) + least(abandoned_refs * 3.0, 25) + least(merged_stale * 0.5, 10)) END", ("branches",)),
}


def _clamped(score: str) -> str:
    return f"CAST(greatest(least(CAST({score} AS DOUBLE), 100), {FLOOR}) AS DOUBLE)"


def _rows(have: set[str]) -> list[tuple[str, str, str]]:
    """(group, name, score expression) of every line that the given reports allow."""
    mean = " + ".join(_clamped(s) for s in PILLARS.values())
    rows = [("overall", "overall", f"floor(({mean}) / {len(PILLARS)} + 0.5)")]
    rows += [("pillars", k, _clamped(s)) for k, s in PILLARS.items()]
    return rows + [("scores", k, f"CASE WHEN ({s}) IS NULL THEN NULL ELSE {_clamped(s)} END") for k, (s, needs) in SUPPLEMENTARY.items() if have & set(needs)]


#: What the overall score means.
_NOTE = "CASE WHEN \"group\" = 'overall' THEN CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'fair' WHEN score >= 60 THEN 'concerning' ELSE 'poor' END ELSE 'see_actions' END"
_LEVEL = "CASE WHEN score >= 80 THEN 'ok' WHEN score >= 60 THEN 'warning' ELSE 'critical' END"


def health(reports: dict[str, DataFrame]) -> DataFrame:
    """``(group, name, score, level, note)`` from the reports by name; missing reports count as without findings."""
    parts = []
    for name, wanted in INPUTS.items():
        if name in reports:
            df = reports[name]
            if name == "churn_pareto":
                df = df.crossJoin(F.broadcast(df.agg(F.count_if(F.col("name") != "<summary>").alias("files_here"))))  # one row
            parts.append(df.selectExpr(*(f"{e.replace('//', 'div')} AS {c}" for c, (e, _) in wanted.items())))
    if not parts:
        raise ValueError("health needs one report at least")
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    one = one.selectExpr("*", *(f"{v} AS {c}" for name, wanted in INPUTS.items() if name not in reports for c, (_, v) in wanted.items()))
    rows = _rows(set(reports))
    lines = [F.struct(F.lit(g).alias("group"), F.lit(n).alias("name"), F.expr(s).cast("double").alias("score")) for g, n, s in rows]
    return one.select(F.inline(F.array(*lines))).filter("score is not null").selectExpr("`group`", "name", "score", f"{_LEVEL} AS level", f"{_NOTE.replace(chr(34), chr(96))} AS note")


def health_sql(reports: dict[str, str]) -> str:
    """The same over SQL texts of the reports."""
    parts = []
    for name, wanted in INPUTS.items():
        if name in reports:
            extra = ", count(*) FILTER (WHERE name <> '<summary>') OVER () AS files_here" if name == "churn_pareto" else ""
            parts.append(f"(SELECT {', '.join(f'{e} AS {c}' for c, (e, _) in wanted.items())} FROM (SELECT *{extra} FROM ({reports[name]})))")
    missing = "".join(f", {v} AS {c}" for name, wanted in INPUTS.items() if name not in reports for c, (_, v) in wanted.items())
    lines = " UNION ALL ".join(f"SELECT '{g}' AS \"group\", '{n}' AS name, CAST({s} AS DOUBLE) AS score FROM one" for g, n, s in _rows(set(reports)))
    return f'WITH one AS (SELECT *{missing} FROM {" CROSS JOIN ".join(parts)}), l AS ({lines}) SELECT "group", name, score, {_LEVEL} AS level, {_NOTE} AS note FROM l WHERE score IS NOT NULL'


#: Commands against bloat by the pattern in a path; else history has to be rewritten.
_UNTRACK = "CASE WHEN contains(name, 'node_modules/') OR name LIKE 'dist/%' OR name LIKE 'build/%' OR name LIKE 'target/%' OR name LIKE 'vendor/%' THEN 'gitignore' WHEN name LIKE '%.min.js' OR name LIKE '%.min.css' THEN 'untrack_build' ELSE 'filter_repo' END"


def _first(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows and their place from 1: a window over ``n`` rows."""
    return df.orderBy(*order).limit(n).withColumn("nth", F.row_number().over(Window.orderBy(*order)))


def _actions(r: dict[str, DataFrame]) -> list[DataFrame]:
    def rows(df: DataFrame, place: str, name: str, level: str, details: str, action: str) -> DataFrame:
        return df.selectExpr("'actions' AS `group`", f"CAST({place} AS INT) AS place", f"{name} AS name", f"'{level}' AS level", f"{details} AS details", f"{action} AS action")

    out = []
    if "quality" in r:
        for k, (row, bar, target, code, level, action) in enumerate((
            ("low_quality_messages", 5, "commit messages", "low_quality", "warning", "enforce_conventional"),
            ("mega_commits", 10, "mega commits", "mega_commits", "warning", "split_commits"),
            ("revert_commits", 3, "revert rate", "high_revert", "critical", "require_review"),
        )):
            found = r["quality"].filter(f"name = '{row}' AND percent > {bar}")
            out.append(rows(found, str(10 + k), f"'commit_discipline: {target}'", level, f"concat('{code} pct=', format_string('%.1f', percent))", f"'{action}'"))
    if "knowledge_silos" in r:
        first = _first(r["knowledge_silos"], 3, F.desc(F.col("risk") == "at_risk"), F.desc("owner_idle_days"), "name").filter("risk = 'at_risk'")
        out.append(rows(first, "20 + nth", "concat('bus_factor: ', name)", "critical", "concat('sole_owner owner=', owner)", "'pair_review'"))
    if "complexity" in r:
        first = _first(r["complexity"], 3, F.desc("cyclomatic"), "name").filter("cyclomatic >= 20")
        out.append(rows(first, "30 + nth", "concat('refactoring_debt: ', name)", "critical", "concat('high_complexity cc=', cyclomatic, ' lines=', lines)", "'extract_branches'"))
    if "large_sources" in r:
        first = _first(r["large_sources"], 1, F.desc("code_lines"), "name").filter("code_lines >= 1500")
        out.append(rows(first, "40", "concat('refactoring_debt: ', name)", "warning", "concat('god_module lines=', code_lines)", "'split_module'"))
    if "debt_markers" in r:
        first = _first(r["debt_markers"], 1, F.desc("age_days"), "name").filter("age_days >= 365")
        out.append(rows(first, "41", "concat('refactoring_debt: ', name)", "warning", "concat('rotten_marker marker=', marker, ' days=', age_days)", "'resolve_marker'"))
    if "bloat" in r:
        first = _first(r["bloat"], 3, F.desc("size_bytes"), "name").filter("recommendation <> 'ok'")
        out.append(rows(first, "50 + nth", "concat('tidiness: ', name)", "warning", "recommendation", _UNTRACK))
    return out


def _hygiene(r: dict[str, DataFrame], folder: dict[str, int] | None, spark) -> list[DataFrame]:
    out = []
    if folder:
        found = [(1, "large_git_dir", f"mb={folder['bytes'] >> 20}", "lfs_migrate", folder["bytes"] >> 30 >= 1), (2, "fragmented_packs", f"packs={folder['packs']}", "repack", folder["packs"] > 50), (3, "loose_objects", f"loose={folder['loose']}", "gc", folder["loose"] > 10_000)]
        made = [("hygiene", p, code, "safe", f"{code} {detail}", action) for p, code, detail, action, over in found if over]
        out.append(spark.createDataFrame(made, "group string, place int, name string, level string, details string, action string"))

    def rows(df: DataFrame, place: str, name: str, level: str, details: str, action: str) -> DataFrame:
        return df.selectExpr("'hygiene' AS `group`", f"CAST({place} AS INT) AS place", f"{name} AS name", f"{level} AS level", f"{details} AS details", f"{action} AS action")

    if "branches" in r:
        n = r["branches"].agg(F.count_if(F.col("recommendation").isin("merged_stale", "merged_recent")).alias("merged"), F.count_if(F.col("recommendation") == "abandoned").alias("abandoned"))
        out.append(rows(n.filter("merged > 0"), "4", "'merged_branches'", "'safe'", "concat('merged_branches count=', merged)", "'delete_merged_branches'"))
        out.append(rows(n.filter("abandoned > 0"), "5", "'abandoned_branches'", "'safe'", "concat('abandoned_branches count=', abandoned)", "'review_abandoned_branches'"))
    if "bloat" in r:
        first = _first(r["bloat"], 5, F.desc("size_bytes"), "name")
        cached = first.filter("recommendation IN ('vendored_deps', 'build_output', 'rust_build_output', 'ide_config')")
        heavy = first.filter("recommendation IN ('large_file', 'very_large_file')")
        out.append(rows(cached, "10 + nth", "name", "'safe'", "concat('bloat reason=', recommendation)", "concat('git rm -rf --cached ', name)"))
        out.append(rows(heavy, "10 + nth", "name", "'history-rewrite'", "concat('bloat reason=', recommendation)", "concat('git filter-repo --invert-paths --path ', name)"))
    return out


def _insights(r: dict[str, DataFrame]) -> list[DataFrame]:
    def rows(df: DataFrame, place: str, name: str, details: str, note: str) -> DataFrame:
        return df.selectExpr("'insights' AS `group`", f"CAST({place} AS INT) AS place", f"{name} AS name", "'info' AS level", f"{details} AS details", f"{note} AS action")

    out = []
    if "authors" in r:
        n = r["authors"].agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        out.append(rows(n, "1", "'team'", "concat('team total=', n)", "'team'"))
    if "ownership" in r:
        n = r["ownership"].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bus_factor") >= 3).alias("well")).filter("n > 0")
        out.append(rows(n, "2", "'ownership'", "concat('ownership well_owned_pct=', well * 100 div n, ' well_owned=', well, ' total_files=', n)", "'ownership'"))
    for place, name, n, a, b, order in ((10, "coupling", 3, "file_a", "file_b", "co_changes"), (20, "module_coupling", 2, "module_a", "module_b", "score")):
        if name in r:
            first = _first(r[name], n, F.desc(order), "name")
            out.append(rows(first, f"{place} + nth", "name", f"concat('{name} {a}=', {a}, ' {b}=', {b}, ' co_changes=', co_changes, ' score=', format_string('%.2f', score))", f"'{name}'"))
    if "fan_in_out" in r:
        first = _first(r["fan_in_out"].filter("role = 'hub'"), 3, F.desc("fan_in"), "name")
        out.append(rows(first, "30 + nth", "name", "concat('hub fan_in=', fan_in)", "'hub'"))
    if "churn" in r:
        n = r["churn"].agg(F.coalesce(F.sum("lines_added"), F.lit(0)).alias("a"), F.coalesce(F.sum("lines_deleted"), F.lit(0)).alias("d")).filter("a > 0 OR d > 0")
        out.append(rows(n, "40", "'churn_trend'", "concat('churn_trend added=', a, ' deleted=', d, ' net=', a - d)", "CASE WHEN a < d THEN 'active_cleanup' ELSE 'growing_codebase' END"))
    if "hotspots" in r:
        n = r["hotspots"].agg(F.count_if((F.col("level") == "file") & (F.col("score") >= 100)).alias("n")).filter("n > 0")
        out.append(rows(n, "41", "'hotspots'", "concat('hotspots count=', n)", "'hotspots'"))
    return out


def findings(reports: dict[str, DataFrame], folder: dict[str, int] | None = None, most: int = 10) -> DataFrame:
    """``(group, place, name, level, details, action)``: the first ``most`` actions in the order of pillars, hygiene, insights.

    ``details`` is a code with its parameters, ``action`` a code or a command. ``folder``: sizes of the git folder.
    """
    if not reports:
        raise ValueError("findings need one report at least")
    spark = next(iter(reports.values())).sparkSession
    parts = {"actions": _actions(reports), "hygiene": _hygiene(reports, folder, spark), "insights": _insights(reports)}
    tables = [reduce(DataFrame.unionByName, x) for x in parts.values() if x]
    if parts["actions"]:
        tables[0] = tables[0].orderBy("place", "name").limit(most)
    return reduce(DataFrame.unionByName, tables).orderBy("group", "place", "name")


def findings_sql(r: dict[str, str]) -> str:
    """The same as DuckDB SQL over the reports' SQL, written apart from the plans above; without a git folder."""
    return f"""
WITH quality AS ({r["quality"]}), silos AS ({r["knowledge_silos"]}), cc AS ({r["complexity"]}), large AS ({r["large_sources"]}), marks AS ({r["debt_markers"]}), bloat AS ({r["bloat"]}),
br AS ({r["branches"]}), au AS ({r["authors"]}), own AS ({r["ownership"]}), cp AS ({r["coupling"]}), mc AS ({r["module_coupling"]}), fio AS ({r["fan_in_out"]}), ch AS ({r["churn"]}), hot AS ({r["hotspots"]}),
big AS (SELECT *, row_number() OVER (ORDER BY size_bytes DESC, name) AS k FROM bloat),
act AS (
 SELECT CASE name WHEN 'low_quality_messages' THEN 10 WHEN 'mega_commits' THEN 11 ELSE 12 END AS place,
  'commit_discipline: ' || CASE name WHEN 'low_quality_messages' THEN 'commit messages' WHEN 'mega_commits' THEN 'mega commits' ELSE 'revert rate' END AS name, CASE name WHEN 'revert_commits' THEN 'critical' ELSE 'warning' END AS level,
  CASE name WHEN 'low_quality_messages' THEN 'low_quality' WHEN 'mega_commits' THEN 'mega_commits' ELSE 'high_revert' END || ' pct=' || printf('%.1f', percent) AS details,
  CASE name WHEN 'low_quality_messages' THEN 'enforce_conventional' WHEN 'mega_commits' THEN 'split_commits' ELSE 'require_review' END AS action
  FROM quality WHERE (name = 'low_quality_messages' AND percent > 5) OR (name = 'mega_commits' AND percent > 10) OR (name = 'revert_commits' AND percent > 3)
 UNION ALL SELECT 20 + k, 'bus_factor: ' || name, 'critical', 'sole_owner owner=' || owner, 'pair_review' FROM (SELECT *, row_number() OVER (ORDER BY (risk = 'at_risk') DESC, owner_idle_days DESC, name) AS k FROM silos) WHERE k <= 3 AND risk = 'at_risk'
 UNION ALL SELECT 30 + k, 'refactoring_debt: ' || name, 'critical', 'high_complexity cc=' || cyclomatic || ' lines=' || lines, 'extract_branches' FROM (SELECT *, row_number() OVER (ORDER BY cyclomatic DESC, name) AS k FROM cc) WHERE k <= 3 AND cyclomatic >= 20
 UNION ALL SELECT 40, 'refactoring_debt: ' || name, 'warning', 'god_module lines=' || code_lines, 'split_module' FROM (SELECT *, row_number() OVER (ORDER BY code_lines DESC, name) AS k FROM large) WHERE k = 1 AND code_lines >= 1500
 UNION ALL SELECT 41, 'refactoring_debt: ' || name, 'warning', 'rotten_marker marker=' || marker || ' days=' || age_days, 'resolve_marker' FROM (SELECT *, row_number() OVER (ORDER BY age_days DESC, name) AS k FROM marks) WHERE k = 1 AND age_days >= 365
 UNION ALL SELECT 50 + k, 'tidiness: ' || name, 'warning', recommendation, CASE WHEN regexp_matches(name, 'node_modules/|^(dist|build|target|vendor)/') THEN 'gitignore' WHEN regexp_matches(name, '[.]min[.](js|css)$') THEN 'untrack_build' ELSE 'filter_repo' END FROM big WHERE k <= 3 AND recommendation <> 'ok'),
rest AS (
 SELECT 'hygiene' AS g, 4 AS place, 'merged_branches' AS name, 'safe' AS level, 'merged_branches count=' || count(*) AS details, 'delete_merged_branches' AS action FROM br WHERE recommendation LIKE 'merged%' HAVING count(*) > 0
 UNION ALL SELECT 'hygiene', 5, 'abandoned_branches', 'safe', 'abandoned_branches count=' || count(*), 'review_abandoned_branches' FROM br WHERE recommendation = 'abandoned' HAVING count(*) > 0
 UNION ALL SELECT 'hygiene', 10 + k, name, 'safe', 'bloat reason=' || recommendation, 'git rm -rf --cached ' || name FROM big WHERE k <= 5 AND recommendation IN ('vendored_deps', 'build_output', 'rust_build_output', 'ide_config')
 UNION ALL SELECT 'hygiene', 10 + k, name, 'history-rewrite', 'bloat reason=' || recommendation, 'git filter-repo --invert-paths --path ' || name FROM big WHERE k <= 5 AND recommendation IN ('large_file', 'very_large_file')
 UNION ALL SELECT 'insights', 1, 'team', 'info', 'team total=' || count(*), 'team' FROM au HAVING count(*) > 0
 UNION ALL SELECT 'insights', 2, 'ownership', 'info', 'ownership well_owned_pct=' || (count(*) FILTER (bus_factor >= 3) * 100 // count(*)) || ' well_owned=' || count(*) FILTER (bus_factor >= 3) || ' total_files=' || count(*), 'ownership' FROM own HAVING count(*) > 0
 UNION ALL SELECT 'insights', 10 + k, name, 'info', 'coupling file_a=' || file_a || ' file_b=' || file_b || ' co_changes=' || co_changes || ' score=' || printf('%.2f', score), 'coupling' FROM (SELECT *, row_number() OVER (ORDER BY co_changes DESC, name) AS k FROM cp) WHERE k <= 3
 UNION ALL SELECT 'insights', 20 + k, name, 'info', 'module_coupling module_a=' || module_a || ' module_b=' || module_b || ' co_changes=' || co_changes || ' score=' || printf('%.2f', score), 'module_coupling' FROM (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS k FROM mc) WHERE k <= 2
 UNION ALL SELECT 'insights', 30 + k, name, 'info', 'hub fan_in=' || fan_in, 'hub' FROM (SELECT *, row_number() OVER (ORDER BY fan_in DESC, name) AS k FROM fio WHERE role = 'hub') WHERE k <= 3
 UNION ALL SELECT 'insights', 40, 'churn_trend', 'info', 'churn_trend added=' || sum(lines_added)::BIGINT || ' deleted=' || sum(lines_deleted)::BIGINT || ' net=' || (sum(lines_added) - sum(lines_deleted))::BIGINT, CASE WHEN sum(lines_added) < sum(lines_deleted) THEN 'active_cleanup' ELSE 'growing_codebase' END FROM ch HAVING sum(lines_added) > 0 OR sum(lines_deleted) > 0
 UNION ALL SELECT 'insights', 41, 'hotspots', 'info', 'hotspots count=' || count(*), 'hotspots' FROM hot WHERE level = 'file' AND score >= 100 HAVING count(*) > 0)
SELECT 'actions' AS "group", CAST(place AS INT) AS place, name, level, details, action FROM (SELECT * FROM act ORDER BY place, name LIMIT 10)
UNION ALL SELECT g, CAST(place AS INT), name, level, details, action FROM rest
"""


def whole(reports: dict[str, DataFrame], folder: dict[str, int] | None = None) -> DataFrame:
    """Scores and findings as one report: ``(group, name, score, level, details, action)``."""
    scores = health(reports).selectExpr("`group`", "name", "score", "level", "CAST(NULL AS STRING) AS details", "note AS action")
    rest = findings(reports, folder).selectExpr("`group`", "name", "CAST(NULL AS DOUBLE) AS score", "level", "details", "action")
    return scores.unionByName(rest)

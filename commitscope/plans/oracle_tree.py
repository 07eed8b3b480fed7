"""DuckDB SQL of the tree reports over the generated Python files, whose measures follow from their columns in closed form."""

from __future__ import annotations

from commitscope.functions import paths as P
from commitscope.plans.oracle import AS_OF
from commitscope.sources.synthetic import prelude

_H = prelude("head_files")
_L = f"""{_H}, l AS (SELECT path, strlen(content) AS bytes, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS line FROM head_files),
 f AS (SELECT path, max(bytes) AS bytes, count(*) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '#')) AS code, count(*) FILTER (starts_with(trim(line), '#')) AS comment, count(*) FILTER (trim(line) = '') AS blank FROM l GROUP BY 1)"""
_EDGES = f"""{_H}, i AS (SELECT path, 'src/' || split_part(split_part(content, 'from src.', 2), '.', 1) || '/' || split_part(split_part(split_part(content, 'from src.', 2), ' import', 1), '.', 2) || '.py' AS target FROM head_files),
 e AS (SELECT path AS source, target FROM i WHERE target IN (SELECT path FROM head_files) AND path <> target)"""
_PART = "'src/' || lower(p_type) || '/m' || p_partkey || '.py'"
_SIZE = "(CASE WHEN {b} >= 1073741824 THEN printf('%.2f GB', {b} / 1073741824.0) WHEN {b} >= 1048576 THEN printf('%.2f MB', {b} / 1048576.0) WHEN {b} >= 1024 THEN printf('%.2f KB', {b} / 1024.0) ELSE {b} || ' B' END)"
_SHORT = "(CASE WHEN {b} >= 1048576 THEN printf('%.2f MB', {b} / 1048576.0) WHEN {b} >= 1024 THEN printf('%.1f KB', {b} / 1024.0) ELSE {b} || ' B' END)"
_STATUS = "CASE WHEN is_head = 'yes' THEN 'head' WHEN merged = 'yes' AND d >= 60 THEN 'merged_stale' WHEN merged = 'yes' THEN 'merged_recent' WHEN d >= 180 THEN 'abandoned' WHEN d >= 60 THEN 'stale' ELSE 'active' END"

SQL = {
    "composition": f"""{_L} SELECT 'Python' AS name, count(*) AS files, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(code + comment + blank) AS BIGINT) AS total_lines,
 100.0::DOUBLE AS code_pct, round(100.0::DOUBLE * sum(comment) / (sum(code) + sum(comment)), 1) AS comment_ratio_pct, CAST(sum(bytes) AS BIGINT) AS bytes FROM f""",
    "quick_composition": f"""{_L} SELECT 'Python' AS language, 100.0::DOUBLE AS percentage, CAST(sum(code) AS BIGINT) AS code_lines, count(*) AS files FROM f WHERE {P.is_source_sql("path")}""",
    "large_sources": f"""{_L} SELECT path AS name, bytes AS size_bytes, {_SHORT.format(b="bytes")} AS size_human, code AS code_lines, comment AS comment_lines, blank AS blank_lines, code + comment + blank AS total_lines, 'Python' AS language, 'sizeable' AS recommendation
 FROM f WHERE code >= 10 ORDER BY code DESC, path LIMIT 100""",
    "test_ratio": f"""{_L}, t AS (SELECT *, {P.is_test_file_sql()} AS test FROM f WHERE {P.is_source_sql("path")}), r AS (SELECT 'Python' AS name, count(*) FILTER (NOT test) AS source_files, count(*) FILTER (test) AS test_files,
 CAST(coalesce(sum(code) FILTER (NOT test), 0) AS BIGINT) AS source_lines, CAST(coalesce(sum(code) FILTER (test), 0) AS BIGINT) AS test_lines FROM t)
 SELECT *, CAST(100 * test_lines // (source_lines + test_lines) AS BIGINT) AS test_pct FROM r UNION ALL SELECT '(total)', source_files, test_files, source_lines, test_lines, CAST(100 * test_lines // (source_lines + test_lines) AS BIGINT) FROM r""",
    "complexity": f"""SELECT {_PART} || '::f' || p_size || ':4' AS name, 1 + p_size % 7 AS cyclomatic, p_size % 7 AS cognitive, 2 + 2 * (p_size % 7) AS lines, 2 AS args, 1 AS exits, 'Python' AS language,
 CASE WHEN p_size % 7 <= 4 THEN 'simple' ELSE 'ok' END AS recommendation FROM part ORDER BY 2 DESC, 1 LIMIT 200""",
    "clones": f"""WITH f AS (SELECT {_PART} AS path, 'f' || p_size AS fn, p_size % 7 AS k, 2 + 2 * (p_size % 7) AS size FROM part WHERE 2 + 2 * (p_size % 7) >= 10),
 g AS (SELECT k, count(*) AS occurrences, min(path) AS path, max(size) AS size_lines FROM f GROUP BY k HAVING count(*) > 1)
 SELECT g.path || '::' || f.fn || ':4' AS name, occurrences, size_lines, (SELECT string_agg(x.path || ':4', ' | ' ORDER BY x.path) FROM f x WHERE x.k = g.k AND x.path <> g.path) AS other_locations FROM g JOIN f ON f.path = g.path""",
    "constructs_python": f"""SELECT {_PART} AS path, 'f' || p_size AS qualified_name, 'function' AS kind, 4 AS start_line, 5 + 2 * (p_size % 7) AS end_line FROM part""",
    "doc_coverage": f"""SELECT {_PART} AS name, 1 AS public_items, 0 AS documented, 0 AS coverage_pct, 'Python' AS language, 'poor' AS recommendation FROM part ORDER BY name LIMIT 200""",
    "fan_in_out": f"""{_EDGES}, p AS (SELECT name, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT source AS name, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY 1)
 SELECT *, CAST(100 * fan_out // (fan_in + fan_out) AS BIGINT) AS instability_pct, CASE WHEN fan_in >= 5 AND fan_out <= 2 THEN 'hub' WHEN fan_out >= 5 AND fan_in <= 1 THEN 'orchestrator' WHEN fan_in = 0 THEN 'leaf' WHEN fan_out = 0 THEN 'pure_dep' ELSE 'mixed' END AS role
 FROM p ORDER BY fan_in DESC, name LIMIT 150""",
    "dead_code": f"""{_EDGES} SELECT path AS name, 'py' AS extension FROM head_files WHERE {P.is_source_sql("path")} AND path NOT IN (SELECT target FROM e) ORDER BY path LIMIT 200""",
    "debt_markers": f"""SELECT {_PART} || ':' || (6 + 2 * (p_size % 7)) AS name, 'TODO' AS marker, -1 AS age_days, '<not-blamed>' AS author, 'dev' || p_size AS owner, 'revisit' AS text, 'age_unknown' AS recommendation FROM part WHERE p_size % 4 = 0 ORDER BY name LIMIT 200""",
    "bloat": f"""{_H}, r AS (SELECT path || '.min.css' AS name, strlen(content) AS size_bytes FROM head_files) SELECT name, size_bytes, {_SIZE.format(b="size_bytes")} AS size_human, 'minified_bundle' AS recommendation FROM r""",
    "branches": f"""{prelude("refs")}, d AS (SELECT *, greatest(datediff('day', last_commit, DATE '{AS_OF}'), 0) AS d FROM refs)
 SELECT {_STATUS} AS "group", name, last_commit, d AS days_since, author, merged, is_head, {_STATUS} AS recommendation FROM d""",
    "ancestors": f"""WITH RECURSIVE edges AS (SELECT o_orderkey AS oid, o_orderkey - 1 AS parent FROM orders WHERE o_orderkey > 0 AND o_orderkey % 50 <> 0),
 a(oid) AS (SELECT oid FROM edges WHERE oid % 50 = 49 UNION SELECT parent FROM edges JOIN a USING (oid)) SELECT oid FROM a""",
    "half_life": f"""{prelude("blame", "head_files")}, c AS (SELECT path FROM head_files WHERE strlen(content) <= 51200 AND ends_with(path, '.py') ORDER BY path LIMIT 50), f AS (SELECT path FROM c WHERE {P.is_source_sql("path")}),
 g AS (SELECT path AS name, CAST(sum(len) AS BIGINT) AS total_lines, CAST(coalesce(sum(len) FILTER (datediff('day', commit_ts, DATE '{AS_OF}') >= 180), 0) AS BIGINT) AS ancient_lines, max(datediff('day', commit_ts, DATE '{AS_OF}')) AS oldest_age_days FROM blame SEMI JOIN f USING (path) GROUP BY 1),
 p AS (SELECT name, total_lines, ancient_lines, CAST(100 * ancient_lines // total_lines AS BIGINT) AS ancient_pct, oldest_age_days FROM g)
 SELECT *, CASE WHEN ancient_pct <= 20 THEN 'hot' WHEN ancient_pct <= 50 THEN 'aging' WHEN ancient_pct <= 80 THEN 'stable' ELSE 'core' END AS recommendation FROM p""",
    "debt_markers_blamed": f"""{prelude("blame")}, m AS (SELECT {_PART} AS path, 6 + 2 * (p_size % 7) AS line, 'dev' || p_size AS owner FROM part WHERE p_size % 4 = 0),
 a AS (SELECT path || ':' || line AS name, 'TODO' AS marker, datediff('day', commit_ts, DATE '{AS_OF}') AS age_days, author, owner, 'revisit' AS text FROM m JOIN blame USING (path) WHERE line BETWEEN line_start AND line_start + len - 1)
 SELECT *, CASE WHEN age_days < 30 THEN 'fresh' WHEN age_days < 180 THEN 'aging' WHEN age_days < 365 THEN 'stale' ELSE 'rotten' END AS recommendation FROM a ORDER BY age_days DESC, name LIMIT 200""",
}

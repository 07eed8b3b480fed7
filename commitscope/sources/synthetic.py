"""History and tree tables derived from the driver's star schema; one text each for Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from commitscope.cluster import stage

_OWNER = "CASE WHEN (l.l_partkey*7 + o.o_orderkey) % 10 < (l.l_partkey % 11) THEN CONCAT('own', CAST(l.l_partkey % 37 AS STRING), '@ex.com') ELSE CONCAT('dev', CAST(o.o_orderkey % 20 AS STRING), '@ex.com') END"
_PATH = """CONCAT(CASE WHEN p.p_partkey % 13 = 0 THEN 'vendor/' ELSE 'src/' END, LOWER(p.p_type), '/f', CAST(CASE WHEN p.p_partkey % 5 = 0 THEN p.p_partkey % 3 ELSE p.p_partkey END AS STRING),
 CASE WHEN p.p_partkey % 11 = 0 THEN '.md' WHEN p.p_partkey % 3 = 0 THEN '.py' ELSE '.rs' END)"""
_BASKET_PATH = "CASE WHEN p.p_size <= 25 THEN CONCAT('src/', LOWER(p.p_type), '/c', CAST(p.p_size % 5 AS STRING), '.rs') ELSE CONCAT('src/r_', LOWER(p.p_type), '_', CAST(p.p_size AS STRING), '/m.rs') END"
_STATUS = "MAX(CASE WHEN l.l_linestatus='F' AND l.l_partkey % 97 = 0 THEN 2 WHEN l.l_linenumber = 1 THEN 0 ELSE 1 END) AS status"
_LINES = "CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS additions, CAST(SUM(CAST(FLOOR(l.l_extendedprice) AS BIGINT) % 13) AS BIGINT) AS deletions"
_FROM = "FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey GROUP BY 1,2,3,4,5,9"

CHANGES_MIX = f"""SELECT CONCAT(CAST(o.o_orderkey AS STRING), ':', {_OWNER}) AS commit_oid, o.o_orderdate AS commit_ts, {_OWNER} AS email,
 CASE o.o_orderkey % 10 WHEN 0 THEN 'wip' WHEN 1 THEN 'Revert "change"' WHEN 2 THEN 'fix' ELSE CONCAT('Process order with priority ', o.o_orderpriority) END AS message,
 {_PATH} AS file_path,
 {_STATUS}, {_LINES}, CASE WHEN o.o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS parent_count {_FROM}"""

CHANGES_BASKET = f"""SELECT CAST(o.o_custkey AS STRING) AS commit_oid, CAST('2000-01-01' AS TIMESTAMP) AS commit_ts, CONCAT('dev', CAST(o.o_custkey % 40 AS STRING), '@ex.com') AS email,
 'basket' AS message, {_BASKET_PATH} AS file_path,
 {_STATUS}, {_LINES}, 1 AS parent_count {_FROM}"""

CHANGES_EVENTS = """SELECT CAST(event_id AS STRING) AS commit_oid, ts AS commit_ts, CONCAT('u', CAST(user_id AS STRING), '@ex.com') AS email, event_type AS message,
 CONCAT('src/', event_type, '/h', CAST(user_id % 5 AS STRING), '.ts') AS file_path, 1 AS status, CAST(FLOOR(value) AS BIGINT) AS additions, CAST(event_id % 4 AS BIGINT) AS deletions, 1 AS parent_count FROM events"""

CONSTRUCTS = """SELECT commit_oid, file_path, CONCAT('fn_', CAST((additions + i) % 9 AS STRING)) AS qualified_name,
 CASE (additions + i) % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind, CAST(1 + (deletions + i) % 40 AS BIGINT) AS lines_touched
 FROM changes_mix CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i) k WHERE i <= additions % 2"""

REFS = """SELECT CONCAT('feature/', CAST(c.c_custkey AS STRING)) AS name, CAST(MAX(o.o_orderdate) AS DATE) AS last_commit, CONCAT('dev', CAST(c.c_custkey % 40 AS STRING), '@ex.com') AS author,
 CASE WHEN c.c_mktsegment IN ('BUILDING','MACHINERY') THEN 'yes' ELSE 'no' END AS merged, CASE WHEN c.c_custkey = 7 THEN 'yes' ELSE 'no' END AS is_head
 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_mktsegment"""

EDGES = "SELECT o_orderkey AS oid, o_orderkey - 1 AS parent FROM orders WHERE o_orderkey > 0 AND o_orderkey % 50 <> 0"

HEAD_FILES = """SELECT CONCAT('src/', LOWER(p_type), '/m', CAST(p_partkey AS STRING), '.py') AS path, CONCAT('# module ', p_name, chr(10), 'from src.', LOWER(p_type), '.m', CAST(p_partkey % 50 AS STRING), ' import x', chr(10), chr(10),
 'def f', CAST(p_size AS STRING), '(a, b):', chr(10), REPEAT(CONCAT('    if a > b:', chr(10), '        a = a - 1', chr(10)), CAST(p_size % 7 AS INT)), '    return a', chr(10),
 CASE WHEN p_size % 4 = 0 THEN CONCAT('# TODO(dev', CAST(p_size AS STRING), '): revisit', chr(10)) ELSE '' END) AS content FROM part"""

BLAME = f"""SELECT CONCAT('src/', LOWER(p_type), '/m', CAST(p_partkey AS STRING), '.py') AS path, CAST(s AS BIGINT) AS line_start, CAST(n AS BIGINT) AS len, CONCAT('dev', CAST(p_partkey % 7 + s AS STRING), '@ex.com') AS author,
 CAST('2001-08-01' AS DATE) - CAST(p_partkey * s % 900 AS INT) AS commit_ts FROM part CROSS JOIN (SELECT 1 AS s, 3 AS n UNION ALL SELECT 4 AS s, 20 AS n) k"""

#: The changes as Spark plans them, with the rows of the texts above: sums under narrow keys, and the columns made of them. An order holds
#: each group of its changes whole, so that the join with the orders has dealt them already; a line carries its numbers, not its prices.
_WITH_PART = f"""(SELECT /*deal*/ l_orderkey, l_partkey, {_STATUS.removeprefix("MAX(").replace(") AS", " AS")}, CAST(l_quantity AS BIGINT) AS additions, CAST(FLOOR(l_extendedprice) AS BIGINT) % 13 AS deletions, p_type, p_size
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) l JOIN orders o ON l.l_orderkey = o.o_orderkey"""
_SUMS = "MAX(status) AS status, CAST(SUM(additions) AS BIGINT) AS additions, CAST(SUM(deletions) AS BIGINT) AS deletions"
#: Bytes of the tables to a task of that join and sum, so that its memory does not grow with them.
TASK_BYTES = 4 << 20
PLANS = {
    "changes_mix": (
        f"""SELECT o.o_orderkey AS k, o.o_orderdate AS commit_ts, CASE WHEN o.o_orderkey % 10 IN (0, 1, 2) THEN '' ELSE o.o_orderpriority END AS priority, {_OWNER} AS email,
 {_PATH.replace("p.p_partkey", "l.l_partkey").replace("p.p_", "l.p_")} AS file_path, {_SUMS} FROM {_WITH_PART} GROUP BY 1, 2, 3, 4, 5""",
        (
            "CONCAT(CAST(k AS STRING), ':', email) AS commit_oid", "commit_ts", "email",
            "CASE k % 10 WHEN 0 THEN 'wip' WHEN 1 THEN 'Revert \"change\"' WHEN 2 THEN 'fix' ELSE CONCAT('Process order with priority ', priority) END AS message",
            "file_path", "status", "additions", "deletions", "CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS parent_count",
        ),
    ),
    "changes_basket": (
        f"SELECT o.o_custkey AS k, {_BASKET_PATH.replace('p.p_', 'l.p_')} AS file_path, {_SUMS} FROM {_WITH_PART} GROUP BY 1, 2",
        (
            "CAST(k AS STRING) AS commit_oid", "CAST('2000-01-01' AS TIMESTAMP) AS commit_ts", "CONCAT('dev', CAST(k % 40 AS STRING), '@ex.com') AS email", "'basket' AS message",
            "file_path", "status", "additions", "deletions", "1 AS parent_count",
        ),
    ),
}

VIEWS = {"changes_mix": CHANGES_MIX, "changes_basket": CHANGES_BASKET, "changes_events": CHANGES_EVENTS, "constructs": CONSTRUCTS, "refs": REFS, "edges": EDGES, "head_files": HEAD_FILES, "blame": BLAME}
_TABLES = {
    "changes_mix": "lineitem orders part", "changes_basket": "lineitem orders part", "changes_events": "events", "constructs": "lineitem orders part",
    "refs": "customer orders", "edges": "orders", "head_files": "part", "blame": "part",
}


_held: dict[tuple[str, str], DataFrame] = {}


@contextmanager
def shared_views(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> Iterator[None]:
    """Within it, ``view`` gives these views from written tables, so that several plans over them do not build them anew."""
    mine = {(sf_dir, n): _read(spark, sf_dir, n, stage) for n in names if (sf_dir, n) not in _held}
    _held.update(mine)
    try:
        yield
    finally:
        for key in mine:
            _held.pop(key, None)


def _read(spark: SparkSession, sf_dir: str, name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A view whose rows, before columns that follow from others, went through ``keep``."""
    size = 0
    for table in _TABLES[name].split():
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        df.createOrReplaceTempView(table)
        size += int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if name == "constructs":
        view(spark, sf_dir, "changes_mix").createOrReplaceTempView("changes_mix")
    sums, columns = PLANS.get(name, (VIEWS[name], ("*",)))
    if size > 16 * TASK_BYTES:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
        sums = sums.replace("/*deal*/", f"/*+ REPARTITION({parts}, l_orderkey) */")
    return keep(spark.sql(sums)).selectExpr(*columns)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _held[sf_dir, name] if (sf_dir, name) in _held else _read(spark, sf_dir, name, lambda df: df)


def prelude(*names: str) -> str:
    """``WITH`` clauses that define the views in DuckDB."""
    wanted = ["changes_mix", *names] if "constructs" in names and "changes_mix" not in names else list(names)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)

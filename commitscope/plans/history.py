"""Reports over the change history: each takes DataFrames and returns one lazy DataFrame.

``changes(commit_oid, commit_ts, email, message, file_path, status, additions, deletions, parent_count)``: a row for
each file of a commit. ``constructs(commit_oid, file_path, qualified_name, kind, lines_touched)``. Ages count from the
literal ``as_of``. Every cap has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitscope.functions import paths as P

IDLE_DAYS = 180


def _day(col: str = "commit_ts") -> Column:
    return F.to_date(col)


def _commits(changes: DataFrame) -> DataFrame:
    """One row a commit; partial sums are formed before the shuffle."""
    return changes.groupBy("commit_oid").agg(
        F.min("commit_ts").alias("commit_ts"), F.min("email").alias("email"), F.max("message").alias("message"), F.max("parent_count").alias("parents"),
        F.sum(F.col("additions") + F.col("deletions")).alias("size"),
    )


def authors(changes: DataFrame) -> DataFrame:
    per = changes.groupBy("email").agg(
        F.countDistinct("commit_oid").alias("commits"), F.sum("additions").alias("lines_added"), F.sum("deletions").alias("lines_deleted"),
        F.countDistinct(_day()).alias("active_days"), F.min(_day()).alias("first_commit"), F.max(_day()).alias("last_commit"),
    )
    return per.withColumnRenamed("email", "name").orderBy(F.desc("commits"), "name")


def hotspots(changes: DataFrame, constructs: DataFrame, cap: int = 500) -> DataFrame:
    files = changes.filter(P.is_source()).groupBy("file_path").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("email").alias("unique_authors"))
    files = files.select(F.col("file_path").alias("name"), F.lit("file").alias("level"), F.lit("").alias("kind"), F.col("file_path").alias("file"), "changes", "unique_authors")
    joined = constructs.join(changes.select("commit_oid", "file_path", "email"), ["commit_oid", "file_path"])
    parts = joined.groupBy("file_path", "qualified_name", "kind").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("email").alias("unique_authors"))
    parts = parts.select(F.concat_ws("::", "file_path", "qualified_name").alias("name"), F.lit("construct").alias("level"), "kind", F.col("file_path").alias("file"), "changes", "unique_authors")
    return files.unionByName(parts).withColumn("score", F.col("changes") * F.col("unique_authors")).orderBy(F.desc("score"), "name", "kind").limit(cap)


def churn(changes: DataFrame, cap: int = 500) -> DataFrame:
    per = changes.filter(P.is_source()).groupBy("file_path").agg(F.sum("additions").alias("lines_added"), F.sum("deletions").alias("lines_deleted"), F.count(F.lit(1)).alias("change_count"))
    total = F.col("lines_added") + F.col("lines_deleted")
    out = per.select(
        F.col("file_path").alias("name"), "lines_added", "lines_deleted", (F.col("lines_added") - F.col("lines_deleted")).alias("net_change"), total.alias("total_churn"),
        "change_count", (total / F.col("change_count")).alias("churn_rate"),
    )
    return out.orderBy(F.desc("total_churn"), "name").limit(cap)


def _bus(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Per key: authors, total, least number of authors with over half of the weight, and the top author (least email of ties)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), "email")
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    ranked = rows.select(*keys, "email", weight, F.row_number().over(order).alias("rn"), F.sum(weight).over(run).alias("cum"), F.sum(weight).over(whole).alias("total"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_authors"), F.max("total").alias("total"),
        F.when(F.max("total") == 0, F.lit(0)).otherwise(F.coalesce(F.min(F.when(2 * F.col("cum") > F.col("total"), F.col("rn"))), F.count(F.lit(1)))).cast("long").alias("bus_factor"),
        F.max(F.when(F.col("rn") == 1, F.col("email"))).alias("top_author"), F.max(F.when(F.col("rn") == 1, F.col(weight))).alias("top"),
    )


def ownership(changes: DataFrame) -> DataFrame:
    per = changes.filter(P.is_source()).groupBy("file_path", "email").agg(F.sum("additions").alias("lines"))
    out = _bus(per, ["file_path"], "lines")
    return out.select(F.col("file_path").alias("name"), "total_authors", "bus_factor", "top_author", F.col("total").alias("total_lines")).orderBy("bus_factor", "name")


def coupling(changes: DataFrame, files: int = 500, pairs: int = 1000, least: int = 3, score: float = 0.3) -> DataFrame:
    top = changes.filter(P.is_source()).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(files)
    slim = changes.select("commit_oid", "file_path").join(F.broadcast(top), "file_path")  # ``files`` rows at most
    a = slim.select("commit_oid", F.col("file_path").alias("file_a"), F.col("n").alias("n_a"))
    b = slim.select("commit_oid", F.col("file_path").alias("file_b"), F.col("n").alias("n_b"))
    both = a.join(b, "commit_oid").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("co_changes"), F.max(F.greatest("n_a", "n_b")).alias("most"))
    both = both.filter(F.col("co_changes") >= least).orderBy(F.desc("co_changes"), "file_a", "file_b").limit(pairs)
    out = both.withColumn("score", F.col("co_changes") / F.col("most")).filter(F.col("score") >= score)
    return out.select(F.concat_ws(" <-> ", "file_a", "file_b").alias("name"), "file_a", "file_b", "co_changes", "score").orderBy(F.desc("co_changes"), "name")


def module_coupling(changes: DataFrame, cap: int = 100, least: int = 3, score: float = 0.3) -> DataFrame:
    seen = changes.filter(P.is_source()).select("commit_oid", P.module_of().alias("module")).distinct()
    totals = seen.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    a, b = seen.select("commit_oid", F.col("module").alias("module_a")), seen.select("commit_oid", F.col("module").alias("module_b"))
    both = a.join(b, "commit_oid").filter("module_a < module_b").groupBy("module_a", "module_b").agg(F.count(F.lit(1)).alias("co_changes")).filter(F.col("co_changes") >= least)
    both = both.join(totals.withColumnsRenamed({"module": "module_a", "n": "n_a"}), "module_a").join(totals.withColumnsRenamed({"module": "module_b", "n": "n_b"}), "module_b")
    out = both.withColumn("score", F.col("co_changes") / F.greatest("n_a", "n_b")).filter(F.col("score") >= score)
    return out.select(F.concat_ws(" <-> ", "module_a", "module_b").alias("name"), "module_a", "module_b", "co_changes", "score").orderBy(F.desc("score"), "name").limit(cap)


def patterns(changes: DataFrame) -> DataFrame:
    """Commits by hour and by weekday, zero rows included."""
    spark = changes.sparkSession
    per = changes.groupBy("commit_oid").agg(F.min("commit_ts").alias("ts"))
    slots = per.groupBy(F.hour("ts").alias("h"), F.weekday("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))  # 168 rows at most
    hours = spark.range(24).select(F.col("id").alias("h")).join(slots.groupBy("h").agg(F.sum("n").alias("n")), "h", "left")
    hours = hours.select(F.lit("hourly").alias("group"), F.format_string("%02d:00", "h").alias("name"), F.col("h").cast("long").alias("order"), F.coalesce("n", F.lit(0)).cast("long").alias("commits"))
    names = F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    days = spark.range(7).select(F.col("id").alias("d")).join(slots.groupBy("d").agg(F.sum("n").alias("n")), "d", "left")
    days = days.select(F.lit("daily").alias("group"), F.element_at(names, (F.col("d") + 1).cast("int")).alias("name"), (F.col("d") + 1).cast("long").alias("order"), F.coalesce("n", F.lit(0)).cast("long").alias("commits"))
    return hours.unionByName(days)


def age(changes: DataFrame, as_of: str) -> DataFrame:
    """Files never deleted; rate of change over their life."""
    per = changes.groupBy("file_path").agg(F.min(_day()).alias("first_seen"), F.max(_day()).alias("last_modified"), F.count(F.lit(1)).alias("change_count"), F.max((F.col("status") == 2).cast("int")).alias("gone"))
    days, since = F.greatest(F.datediff(F.lit(as_of), "first_seen"), F.lit(0)), F.greatest(F.datediff(F.lit(as_of), "last_modified"), F.lit(0))
    rate = F.when(days == 0, F.col("change_count").cast("double")).otherwise(F.col("change_count") / (days / F.lit(365.25)))
    out = per.filter("gone = 0").select(F.col("file_path").alias("name"), days.cast("long").alias("age_days"), "first_seen", "last_modified", since.cast("long").alias("days_since_last_change"), "change_count", rate.alias("changes_per_year"))
    return out.orderBy(F.desc("changes_per_year"), "name")


def outliers(changes: DataFrame, churn_at: int = 100, authors_at: int = 5, cap: int = 5000) -> DataFrame:
    """Never-deleted files with many changes or authors; the cap comes before the source filter."""
    per = changes.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("change_count"), F.countDistinct("email").alias("unique_authors"), F.sum(F.col("additions") + F.col("deletions")).alias("total_churn"), F.max((F.col("status") == 2).cast("int")).alias("gone")
    )
    many, shared = F.col("change_count") >= churn_at, F.col("unique_authors") >= authors_at
    top = per.filter((F.col("gone") == 0) & (many | shared)).orderBy(F.desc("change_count"), "file_path").limit(cap).filter(P.is_source())
    advice = F.when(many & shared, "god_file").when(many, "high_churn").when(shared, "diffuse_ownership").otherwise("ok")
    return top.select(F.col("file_path").alias("name"), "change_count", "unique_authors", "total_churn", advice.alias("recommendation")).orderBy(F.desc("change_count"), "name")


def quality(changes: DataFrame) -> DataFrame:
    """Seven rows on commit messages and shapes; one global aggregation."""
    line = F.trim(F.substring_index(F.coalesce("message", F.lit("")), "\n", 1))
    low = F.lower(line)
    c = _commits(changes).select("size", "parents", F.char_length(line).alias("len"), (low.isin(*P.LOW_QUALITY) | low.rlike(P.LOW_PREFIX)).alias("low"), low.rlike("^revert[ :]").alias("revert"))
    one = c.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("len") < 10).alias("short"), F.count_if("low").alias("low"), F.count_if(F.col("size") > 1000).alias("mega"), F.count_if("revert").alias("revert"),
        F.count_if(F.col("parents") > 1).alias("merge"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg"),
    )
    pct = lambda x: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.col(x) / F.col("n"))
    row = lambda name, commits, share, limit, code: F.struct(F.lit(name).alias("name"), commits.cast("long").alias("commits"), share.cast("double").alias("percent"), F.when(share > limit, code).otherwise("ok").alias("recommendation"))
    rows = F.array(
        F.struct(F.lit("total_commits").alias("name"), F.col("n").cast("long").alias("commits"), F.lit(100.0).alias("percent"), F.lit("baseline").alias("recommendation")),
        row("short_messages", F.col("short"), pct("short"), 20, "enforce_msg_length"), row("low_quality_messages", F.col("low"), pct("low"), 5, "squash_wip"),
        row("mega_commits", F.col("mega"), pct("mega"), 10, "split_mega"), row("revert_commits", F.col("revert"), pct("revert"), 3, "strengthen_review"),
        row("merge_commits", F.col("merge"), pct("merge"), 30, "rebase_workflow"),
        F.struct(F.lit("avg_message_length").alias("name"), F.floor("avg").cast("long").alias("commits"), F.lit(0.0).alias("percent"), F.when(F.col("avg") < 30, "require_descriptions").otherwise("ok").alias("recommendation")),
    )
    return one.select(F.inline(rows))


def _with_changes(constructs: DataFrame, changes: DataFrame) -> DataFrame:
    return constructs.join(changes.select("commit_oid", "file_path", "email", "commit_ts"), ["commit_oid", "file_path"])


def construct_churn(changes: DataFrame, constructs: DataFrame, cap: int = 500) -> DataFrame:
    per = _with_changes(constructs, changes).groupBy("file_path", "qualified_name", "kind").agg(
        F.count(F.lit(1)).alias("changes"), F.sum("lines_touched").alias("lines_touched"), F.countDistinct("email").alias("unique_authors"), F.max(_day()).alias("last_modified")
    )
    top = per.orderBy(F.desc("changes"), "file_path", "qualified_name", "kind").limit(cap).filter(P.is_source())
    return top.select(F.concat_ws("::", "file_path", "qualified_name").alias("name"), "kind", F.col("file_path").alias("file"), "changes", "lines_touched", "unique_authors", "last_modified")


def construct_ownership(changes: DataFrame, constructs: DataFrame, cap: int = 500) -> DataFrame:
    joined = _with_changes(constructs, changes)
    keys = ["file_path", "qualified_name", "kind"]
    top = joined.groupBy(*keys).agg(F.sum("lines_touched").alias("n")).orderBy(F.desc("n"), *keys).limit(cap).filter(P.is_source())
    mine = joined.join(F.broadcast(top.select(*keys)), keys, "left_semi").groupBy(*keys, "email").agg(F.sum("lines_touched").alias("t"))  # ``cap`` rows at most
    named = mine.withColumn("t", F.greatest("t", F.lit(1)))
    kinds = named.groupBy("file_path", "qualified_name").agg(F.min("kind").alias("kind"))
    merged = named.groupBy("file_path", "qualified_name", "email").agg(F.sum("t").alias("t"))
    out = _bus(merged, ["file_path", "qualified_name"], "t").join(kinds, ["file_path", "qualified_name"])
    return out.select(
        F.concat_ws("::", "file_path", "qualified_name").alias("name"), "kind", F.col("file_path").alias("file"), "top_author", F.floor(F.lit(100) * F.col("top") / F.col("total")).cast("long").alias("top_pct"),
        "total_authors", "bus_factor", F.col("total").alias("touches"),
    ).orderBy("bus_factor", F.desc("touches"), "name")


def succession(changes: DataFrame, as_of: str, files: int = 500, cap: int = 200) -> DataFrame:
    top = changes.groupBy("file_path").agg(F.countDistinct("commit_oid").alias("n")).orderBy(F.desc("n"), "file_path").limit(files).filter(P.is_source())
    per = changes.join(F.broadcast(top.select("file_path")), "file_path", "left_semi").groupBy("file_path", "email").agg(  # ``files`` rows at most
        F.countDistinct("commit_oid").alias("commits"), F.min("commit_ts").alias("first_ts"), F.max("commit_ts").alias("last_ts")
    )
    last = changes.groupBy("email").agg(F.max("commit_ts").alias("seen"))
    one = per.groupBy("file_path").agg(
        F.min(F.struct("first_ts", "email")).getField("email").alias("original_author"), F.max(F.struct("commits", "last_ts", "email")).getField("email").alias("current_top"), F.count(F.lit(1)).alias("total_authors")
    )
    out = one.join(last, F.col("original_author") == F.col("email"), "left").withColumn("active", F.coalesce(F.datediff(F.lit(as_of), "seen") <= IDLE_DAYS, F.lit(False)))
    others = F.col("total_authors") - 1
    status = F.when(F.col("active") & (F.col("total_authors") >= 3), "healthy").when(F.col("active"), "owned").when(others == 0, "orphaned").when(others == 1, "knowledge_transfer_needed").otherwise("handed_off")
    rank = F.when(F.col("status") == "orphaned", 4).when(F.col("status") == "knowledge_transfer_needed", 3).when(F.col("status") == "handed_off", 2).when(F.col("status") == "owned", 1).otherwise(0)
    out = out.select(F.col("file_path").alias("name"), "original_author", F.col("active").cast("long").alias("original_active"), "current_top", "total_authors", others.alias("successors"), status.alias("status"))
    return out.orderBy(F.desc(rank), "name").limit(cap)


def knowledge_silos(changes: DataFrame, as_of: str, files: int = 2000, cap: int = 150) -> DataFrame:
    top = changes.groupBy("file_path").agg(F.sum("additions").alias("n")).orderBy(F.desc("n"), "file_path").limit(files).filter(P.is_source())
    per = changes.join(F.broadcast(top.select("file_path")), "file_path", "left_semi").groupBy("file_path", "email").agg(F.sum("additions").alias("lines"), F.max("commit_ts").alias("last_ts"))  # ``files`` rows
    best = per.groupBy("file_path").agg(F.max(F.struct("lines", "email", "last_ts")).alias("o"), F.sum("lines").alias("total_lines")).filter("total_lines > 0")
    idle = F.datediff(F.lit(as_of), F.col("o.last_ts"))
    out = best.select(
        F.col("file_path").alias("name"), F.col("o.email").alias("owner"), F.floor(F.lit(100) * F.col("o.lines") / F.col("total_lines")).cast("long").alias("ownership_pct"),
        _day("o.last_ts").alias("owner_last_touch"), idle.cast("long").alias("owner_idle_days"), "total_lines", F.when(idle >= IDLE_DAYS, "at_risk").otherwise("single_owner").alias("risk"),
    ).filter("ownership_pct >= 80")
    return out.orderBy(F.desc(F.col("risk") == "at_risk"), F.desc("owner_idle_days"), "name").limit(cap)


def _before(rows: DataFrame, by: str, sums: dict[str, Column], descending: bool = False, width: int = 1024) -> DataFrame:
    """``rows`` (a row a value of ``by``) with sums over all rows before each in the order of ``by``.

    Values are cut into blocks of ``width``: rows are ordered within their block, in parallel, and only the blocks' sums,
    one row for ``width`` values, are ordered as a whole.
    """
    way = F.desc if descending else F.asc
    rows = rows.withColumn("block", F.floor(F.col(by) / width)).withColumns(sums)
    blocks = rows.groupBy("block").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"{c}_base") for c in sums])
    inside = Window.partitionBy("block").orderBy(way(by)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(blocks, "block")
    return rows.withColumns({c: F.col(c) + F.col(f"{c}_base") for c in sums}).drop("block", *[f"{c}_base" for c in sums])


def churn_pareto(changes: DataFrame, cap: int = 50) -> DataFrame:
    """Top files with cumulative shares, and how many files make 50, 80 and 90 per cent of churn.

    The cumulative counts run over distinct churn values, not over files.
    """
    files = changes.filter(P.is_source()).groupBy("file_path").agg(F.sum(F.col("additions") + F.col("deletions")).alias("churn")).filter("churn > 0")
    values = files.groupBy("churn").agg(F.count(F.lit(1)).alias("n"))
    steps = _before(values, "churn", {"before": F.col("churn") * F.col("n"), "files_before": F.col("n")}, descending=True)
    total = values.agg(F.sum(F.col("churn") * F.col("n")).alias("total"), F.sum("n").alias("files"))
    hit = steps.crossJoin(F.broadcast(total))  # one row
    target = lambda p: F.floor(F.col("total") * p / 100).cast("long")
    reach = lambda p: F.min(F.when(F.col("before") + F.col("churn") * F.col("n") >= target(p), F.col("files_before") + F.greatest(F.lit(1), F.ceil((target(p) - F.col("before")) / F.col("churn")))))
    summary = hit.agg(F.max("files").alias("rank"), F.max("total").alias("churn"), *[reach(p).cast("long").alias(f"p{p}") for p in (50, 80, 90)])
    nothing = [F.lit(None).cast("long").alias(c) for c in ("pct_of_total", "cumulative_pct")]
    summary = summary.filter("rank is not null").select(F.lit("<summary>").alias("name"), "rank", "churn", *nothing, "p50", "p80", "p90")
    top = files.orderBy(F.desc("churn"), "file_path").limit(cap)
    w = Window.orderBy(F.desc("churn"), "file_path")  # over ``cap`` rows
    ranked = top.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("cum", F.sum("churn").over(w.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    share = lambda c: F.floor(F.lit(100) * F.col(c) / F.col("total")).cast("long")
    none = [F.lit(None).cast("long").alias(f"p{p}") for p in (50, 80, 90)]
    return summary.unionByName(ranked.select(F.col("file_path").alias("name"), "rank", "churn", share("churn").alias("pct_of_total"), share("cum").alias("cumulative_pct"), *none))


def commit_velocity(changes: DataFrame) -> DataFrame:
    c = _commits(changes).withColumn("day", _day())
    both = c.select(F.explode(F.array(F.struct(F.lit("weekly").alias("group"), P.week_of(F.col("day")).alias("name")), F.struct(F.lit("monthly").alias("group"), F.date_format("day", "yyyy-MM").alias("name")))).alias("k"), "size")
    return both.groupBy("k.group", "k.name").agg(F.count(F.lit(1)).alias("commits"), F.sum("size").alias("lines_changed")).orderBy("group", "name")


def commit_size(changes: DataFrame, cap: int = 25) -> DataFrame:
    """Nearest-rank statistics of commit sizes (from counts per size), and the largest anomalies."""
    c = _commits(changes)
    sizes = c.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    cum = _before(sizes, "size", {"less": F.col("n")}).withColumn("cum", F.col("less") + F.col("n")).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all"))))
    at = lambda k: F.min(F.when(F.col("cum") > k, F.col("size")))
    index = lambda p: F.least(F.floor(F.col("all") * p), F.col("all") - 1)
    s = cum.agg(
        F.max("all").alias("commits"), F.floor(F.sum(F.col("size") * F.col("n")) / F.max("all") + F.lit(0.5)).cast("long").alias("mean"), at(F.floor(F.col("all") / 2)).alias("median"),
        at(index(0.95)).alias("p95"), at(index(0.99)).alias("p99"), F.max("size").alias("max"),
    ).filter("commits is not null").withColumn("bar", F.greatest(F.col("p95") * 10, F.col("p99")))
    odd = c.crossJoin(F.broadcast(s.select("bar"))).filter("size > bar")  # one row
    n = odd.agg(F.count(F.lit(1)).alias("anomaly_count"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    summary = s.crossJoin(n).select(F.lit("summary").alias("group"), F.lit("overall").alias("name"), "commits", "mean", "median", "p95", "p99", "max", "anomaly_count", *none("long", "lines_changed"), *none("string", "author"), *none("date", "date"), *none("string", "message"))
    top = odd.orderBy(F.desc("size"), "commit_oid").limit(cap)
    rows = top.select(
        F.lit("anomalies").alias("group"), F.left("commit_oid", F.lit(12)).alias("name"), *none("long", "commits", "mean", "median", "p95", "p99", "max", "anomaly_count"), F.col("size").alias("lines_changed"),
        F.col("email").alias("author"), _day().alias("date"), F.left(F.substring_index(F.coalesce("message", F.lit("")), "\n", 1), F.lit(80)).alias("message"),
    )
    return summary.unionByName(rows)


def time_range(changes: DataFrame, since_days: int | None = None, as_of: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Changes of the last days before ``as_of``, or between two days, both included."""
    out = changes
    if since_days is not None:
        out = out.filter(F.datediff(F.lit(as_of), "commit_ts") <= since_days)
    if start is not None:
        out = out.filter(_day() >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(_day() <= F.lit(end).cast("date"))
    return out

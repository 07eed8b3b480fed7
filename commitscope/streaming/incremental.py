"""Reports kept up to date over a stream of ``changes`` rows.

Event time is ``commit_ts`` (a timestamp); rows later than the watermark are left out, so state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_velocity(changes: DataFrame, late: str = "30 days") -> DataFrame:
    """Commits and lines by Monday-aligned week, in append mode: a week is given once, when the watermark has passed it.

    Files are summed by commit first, so a commit counts once, exactly, however many files it has.
    """
    rows = changes.withColumn("ts", F.col("commit_ts").cast("timestamp")).withWatermark("ts", late)
    week = ("7 days", "7 days", "4 days")
    each = rows.groupBy(F.window("ts", *week).alias("w"), "commit_oid").agg(F.sum(F.col("additions") + F.col("deletions")).alias("lines"))
    per = each.groupBy(F.window("w", *week).alias("week")).agg(F.count(F.lit(1)).alias("commits"), F.sum("lines").alias("lines_changed"))
    return per.select(F.col("week.start").cast("date").alias("week"), "commits", "lines_changed")


def file_churn(changes: DataFrame) -> DataFrame:
    """Lines added and deleted by file so far, in update or complete mode; one small row of state a file."""
    per = changes.groupBy("file_path").agg(F.sum("additions").alias("lines_added"), F.sum("deletions").alias("lines_deleted"))
    return per.select("file_path", "lines_added", "lines_deleted", (F.col("lines_added") + F.col("lines_deleted")).alias("total_churn"))


def first_rows(changes: DataFrame, late: str = "30 days") -> DataFrame:
    """One row a commit: repeats of its id within the watermark are dropped."""
    return changes.withColumn("ts", F.col("commit_ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["commit_oid"])


def author_sessions(changes: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Spells of work of each author: a session ends after ``gap`` without a change."""
    rows = changes.withColumn("ts", F.col("commit_ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("email", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("changes")).select("email", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "changes")

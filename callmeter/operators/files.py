"""What file events tell: re-reads, loaded but unused files, edit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c = F.col
AT = ("t_us", "turn_id")


def reread_calls(events: DataFrame) -> DataFrame:
    """Reads of a path the same thread had already read.

    The first read of each path is an aggregate, so no group of reads is ordered in one task.
    """
    keys = ["session_key", "thread", "path"]
    reads = events.filter(c("action") == "read")
    first = reads.groupBy(*keys).agg(F.min(F.struct(*AT)).alias("__first"))
    return reads.join(first, keys).filter(F.struct(*AT) > c("__first")).drop("__first")


def unused_files(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Per session, files read since its context was last cut, and how many were never touched again.

    A context is cut by a compaction or by falling below half. Flagged with 10 or more files, 70% idle.
    """
    from callmeter.operators.cache import call_pairs

    pairs = call_pairs(calls)
    cut_at = pairs.filter(c("after_compaction") | (c("input_total") < 0.5 * c("prev.input_total"))).groupBy("session_key").agg(
        F.max("t_us").alias("__since"))
    live = events.join(cut_at, "session_key", "left").filter(c("__since").isNull() | (c("t_us") >= c("__since")))
    at = F.struct(*AT)
    read, write = c("action") == "read", c("action") == "write"
    per_path = live.groupBy("session_key", "path").agg(
        F.count(F.when(read, 1)).alias("reads"), F.min(F.when(read, at)).alias("first_read"), F.max(F.when(write, at)).alias("last_write"))
    touched = (c("reads") > 1) | F.coalesce(c("last_write") > c("first_read"), F.lit(False))
    sums = per_path.filter(c("reads") > 0).groupBy("session_key").agg(
        F.count(F.lit(1)).alias("loaded"), F.count(F.when(~touched, 1)).alias("unused"))
    return sums.withColumn("flagged", (c("loaded") >= 10) & (c("unused") >= 0.7 * c("loaded")))


def edit_rate(events: DataFrame, families: DataFrame) -> DataFrame:
    """Per family, the share of files its tasks read that they also wrote."""
    per_path = events.groupBy("task_id", "path").agg(
        F.bool_or(c("action") == "read").alias("r"), F.bool_or(c("action") == "write").alias("w"))
    rows = per_path.filter(c("r")).join(families.select("task_id", "family"), "task_id")
    return rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("files_read"), F.count(F.when(c("w"), 1)).alias("files_edited"),
        F.round(100 * F.avg(c("w").cast("double")), 4).alias("edit_rate"))

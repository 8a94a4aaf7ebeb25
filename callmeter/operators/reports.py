"""Report tables: where the tokens and the money went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.functions.labels import CATEGORIES, pseudonym
from callmeter.functions.money import dollars, exact_sum
from callmeter.operators.ordered import running_sum, scan
from callmeter.operators.tasks import is_main

c = F.col


def _cost() -> Column:
    return F.coalesce(exact_sum("cost_p"), F.lit(0).cast("decimal(30,0)"))


def share(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 when there is nothing to share."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part.cast("double") / whole.cast("double"), 1))


def totals(calls: DataFrame) -> DataFrame:
    rec = c("recovered") != 0
    return calls.agg(
        F.count(F.lit(1)).alias("turns"),
        F.countDistinct("source", "task_id").alias("tasks"), F.countDistinct("session_key").alias("sessions"),
        *[F.sum(n).alias(n) for n in ("tokens", "input_new", "cache_read", "cache_write", "output")],
        F.coalesce(F.sum("reasoning"), F.lit(0)).alias("reasoning"),
        F.sum("output_logged").alias("output_logged"), F.sum("recovered").alias("recovered"),
        F.count(F.when(rec, 1)).alias("recovered_calls"),
        dollars(F.coalesce(exact_sum(F.when(rec, c("recovered") * c("p_out"))), F.lit(0)), 4).alias("recovered_cost"),
        dollars(_cost(), 4).alias("cost"),
        F.count(F.when(c("cost_p").isNull(), 1)).alias("unpriced_turns"),
        F.count(F.when(~c("output_exact"), 1)).alias("inexact_turns"),
        F.coalesce(F.sum(F.when(~c("output_exact"), c("output"))), F.lit(0)).alias("inexact_output"),
    )


def by_category(calls: DataFrame) -> DataFrame:
    names = calls.sparkSession.createDataFrame([(n,) for n in CATEGORIES], "category string")
    sums = calls.groupBy("category").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), _cost().alias("cost_p"),
        F.sum("recovered").alias("recovered"))
    full = names.join(sums, "category", "left").fillna(0, ["turns", "tokens", "recovered"]).withColumn(
        "cost_p", F.coalesce("cost_p", F.lit(0).cast("decimal(30,0)")))
    every = Window.partitionBy()  # four rows
    return full.select(
        "category", "turns", "tokens", dollars(c("cost_p"), 4).alias("cost"), "recovered",
        share(c("tokens"), F.sum("tokens").over(every)).alias("token_share"),
        share(c("cost_p"), F.sum("cost_p").over(every)).alias("cost_share"))


def by_session(calls: DataFrame) -> DataFrame:
    sub = F.coalesce(exact_sum(F.when(~is_main(), c("cost_p"))), F.lit(0))
    return calls.groupBy("session_key").agg(
        F.min("t_us").alias("started_us"), F.min_by("project", F.struct("t_us", "turn_id")).alias("project"),
        F.count(F.lit(1)).alias("turns"), F.countDistinct("source", "task_id").alias("tasks"),
        F.sum("tokens").alias("tokens"), _cost().alias("cost_p"), sub.alias("sub_p"),
    ).select("session_key", "started_us", "project", "turns", "tasks", "tokens",
             dollars(c("cost_p"), 4).alias("cost"), share(c("sub_p"), c("cost_p")).alias("subagent_cost_share"))


def by_month(calls: DataFrame) -> DataFrame:
    month = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM")
    return calls.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_total").alias("input"), F.sum("output").alias("output"),
        F.sum("tokens").alias("tokens"), dollars(_cost(), 4).alias("cost"), F.sum("recovered").alias("recovered"))


def top_tasks(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n most expensive tasks (ties by id)."""
    return stats.orderBy(c("cost_p").desc(), "task_id").limit(n).select(
        "task_id", "session_key", "project", "family", "turns_main", "turns_sub", "tokens", "recovered",
        dollars(c("cost_p"), 4).alias("cost"))


def top_per_group(df: DataFrame, group: list[str], by: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; the cut runs before the shuffle."""
    return (df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
            .filter(c(rank) <= n))


def anonymized(sessions: DataFrame) -> DataFrame:
    """Stable fake names: hashes for sessions, letters by first appearance for projects."""
    first = sessions.groupBy("project").agg(F.min(F.struct("started_us", "session_key")).alias("__first"))
    # projects are a dimension: one row per project, numbered in order of appearance
    numbered = scan(first.select("project", "__first"), [], ["__first", "project"],
                    n=running_sum(F.lit(1).cast("bigint"), inclusive=False))
    letter = F.concat(F.lit("project-"), F.char((F.lit(65) + c("n") % 26).cast("int")),
                      F.when(c("n") >= 26, F.floor(c("n") / 26).cast("string")).otherwise(""))
    return sessions.join(numbered.select("project", letter.alias("project_name")), "project").withColumn(
        "session_name", pseudonym(c("session_key")))


def parse_quality(outcomes: DataFrame) -> DataFrame:
    """Add up line outcomes by bucket and reason."""
    return outcomes.groupBy("bucket", "reason").agg(F.sum("n").alias("n"))


def time_span(calls: DataFrame) -> DataFrame:
    return calls.agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("calls"))


def filter_calls(calls: DataFrame, since_us: int | None = None, until_us: int | None = None,
                 project: str | None = None, session_key=None) -> DataFrame:
    """Period, project (case-insensitive substring) and session filters, all pushed to the scan."""
    if since_us is not None:
        calls = calls.filter(c("t_us") >= since_us)
    if until_us is not None:
        calls = calls.filter(c("t_us") < until_us)
    if project:
        calls = calls.filter(F.lower("project").contains(project.lower()))
    if session_key is not None:
        calls = calls.filter(c("session_key") == session_key)
    return calls

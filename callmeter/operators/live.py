"""Figures for running sessions: turns still ahead, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callmeter.functions.labels import MIN_CACHEABLE, shell_slice
from callmeter.functions.money import dollars, exact_sum
from callmeter.operators.ordered import last_seen, scan
from callmeter.operators.signs import early_tools
from callmeter.operators.tasks import main_calls, pos

c = F.col
MIN_K, SHELL_K, MIN_REACHED = 3, 3, 30


def running_tasks(stats: DataFrame) -> DataFrame:
    """Each session's newest main-thread task, when it is tied to a prompt and has made 3 turns."""
    last = stats.filter("turns_main > 0").groupBy("session_key").agg(
        F.max_by(F.struct("source", "task_id", "turns_main", "tracked"), F.struct("last_us", "task_id")).alias("t"))
    return last.select("session_key", "t.*").filter(c("tracked") & (c("turns_main") >= MIN_K)).select(
        "session_key", "source", "task_id", c("turns_main").alias("k"))


def turns_ahead(stats: DataFrame, calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Median and high bound of the turns running tasks will still make, from 30 or more past tasks that reached k.

    At k = 3 only past tasks that ran as many shell commands in their first three turns count, if
    there are 30. History is a histogram of turn counts, so each running k costs one pass over it;
    the running task itself is one task of k turns and is taken out of the count.
    """
    history = stats.filter(c("tracked") & (c("turns_main") > 0))
    shell = early_tools(calls, tools, (SHELL_K,)).select("source", "task_id", shell_slice(c("shell")).alias("shell_kind"))
    running = running_tasks(stats).join(shell.withColumnRenamed("shell_kind", "shell_slice"), ["source", "task_id"], "left")
    hist = history.groupBy("turns_main").agg(F.count(F.lit(1)).alias("f"))
    sliced = (history.filter(c("turns_main") >= SHELL_K).join(shell, ["source", "task_id"])
              .groupBy("shell_kind", "turns_main").agg(F.count(F.lit(1)).alias("f")))

    def ahead(cells: DataFrame, keys: list[str]) -> DataFrame:
        # both sides hold one row per distinct turn count
        rest = cells.withColumn("f", c("f") - F.when(c("turns_main") == c("k"), 1).otherwise(0)).filter("f > 0")
        q = F.percentile(c("turns_main") - c("k"), F.array(F.lit(0.5), F.lit(0.875)), c("f"))
        return rest.groupBy(*keys).agg(F.sum("f").alias("n"), q.alias("q")).filter(c("n") >= MIN_REACHED)

    ks = running.select("k").distinct()
    all_k = ahead(hist.join(ks, c("turns_main") >= c("k")), ["k"])
    at3 = ahead(sliced.withColumn("k", F.lit(SHELL_K).cast("bigint")), ["k", "shell_kind"]).select(
        "k", c("shell_kind").alias("shell_slice"), c("n").alias("n3"), c("q").alias("q3"))
    out = running.join(all_k, "k", "left").join(at3, ["k", "shell_slice"], "left")
    use3 = c("n3").isNotNull()
    return out.withColumns({
        "basis": F.when(use3, F.concat(c("shell_slice"), F.lit(" shell"))).otherwise("all"),
        "n": F.coalesce("n3", "n"), "q": F.coalesce("q3", "q"),
    }).filter(c("n").isNotNull()).select(
        "session_key", "task_id", "k", "basis", "n", F.round(c("q")[0], 6).alias("p50"), F.round(c("q")[1], 6).alias("hi"))


def session_alerts(calls: DataFrame, status: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """Per session: value so far and what needs attention.

    A missed cache is judged on the last two main calls; risky lines are unreadable ones (a cut last line
    aside) and unknown records that carry token fields.
    """
    money = calls.groupBy("session_key").agg(
        dollars(F.coalesce(exact_sum("cost_p"), F.lit(0)), 4).alias("cost"), F.count(F.when(c("cost_p").isNull(), 1)).alias("unpriced"))
    fields = F.struct("t_us", "input_total", "output", "cache_read")
    pairs = scan(main_calls(calls), ["session_key"], ["t_us", "turn_id"], prev=last_seen(fields))
    last = pairs.groupBy("session_key").agg(F.max_by(F.struct("input_total", "output", "cache_read", "prev"), pos()).alias("l"))
    missed = ((c("l.prev.input_total") >= MIN_CACHEABLE) & (c("l.cache_read") < 0.5 * c("l.prev.input_total"))
              & (c("l.input_total") >= 0.5 * c("l.prev.input_total")))
    out = money.join(last.select("session_key", F.coalesce(missed, F.lit(False)).alias("cache_missed"),
                                 (c("l.input_total") + c("l.output")).alias("context")), "session_key", "left")
    if status is not None:
        out = out.join(status.select("session_key", (~c("exact")).alias("counter_disagrees")), "session_key", "left").fillna(
            False, ["counter_disagrees"])
    if outcomes is not None:
        risky = (F.when((c("bucket") == "unreadable") & (c("reason") != "truncated_last_line"), c("n"))
                 .when(c("bucket") == "unknown_with_tokens", c("n")).otherwise(0))
        out = out.join(outcomes.groupBy("session_key").agg(F.sum(risky).alias("risky_lines")), "session_key", "left").fillna(
            0, ["risky_lines"])
    return out

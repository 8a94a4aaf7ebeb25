"""Estimates against what happened: linking, outcomes, scorecard, and the computed part's backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callmeter.operators.cache import SECOND_US, call_pairs
from callmeter.operators.ordered import merge, next_seen, scan
from callmeter.operators.quantiles import exact_percentiles
from callmeter.operators.scores import inside

c = F.col
LINK_US, FINISHED_US, SLACK_US = 1800 * SECOND_US, 3600 * SECOND_US, 5 * SECOND_US


def settle(estimates: DataFrame, tasks: DataFrame, now_us: int, taken: DataFrame | None = None,
           rows: int | None = None) -> DataFrame:
    """Status and task of each open estimate (est_id, session_key, made_us), plus `finished`.

    linked: the first task of the session from 5 s before to 30 min after; of several estimates the
    newest has it (lowest id on ties), the others are superseded, as are estimates of a task already
    `taken`. unmatched: none after 30 min. A forward as-of join in one ordered pass, not a range join.
    """
    real = tasks.filter(c("tracked") & (c("turns_main") > 0))
    marks = real.select("session_key", c("started_us").alias("at"), F.lit(1).alias("__task"), c("task_id").alias("__id"),
                        "started_us")
    asks = estimates.select("session_key", (c("made_us") - SLACK_US).alias("at"), F.lit(0).alias("__task"), "est_id", "made_us")
    found = scan(merge(asks, marks, ["session_key"], "at", rows), ["session_key"], ["at", "__task", "__id", "est_id"],
                 next=next_seen(F.when(c("__task") == 1, F.struct("started_us", c("__id").alias("task_id"))))).filter("__task = 0")
    near = c("next.started_us") - c("made_us") <= LINK_US
    near_rows = found.select("est_id", "session_key", "made_us", F.when(near, c("next.task_id")).alias("task_id"))
    if taken is not None:
        near_rows = near_rows.join(taken.select("session_key", "task_id", F.lit(True).alias("__taken")), ["session_key", "task_id"], "left")
    else:
        near_rows = near_rows.withColumn("__taken", F.lit(None).cast("boolean"))
    newest = near_rows.filter(c("task_id").isNotNull()).groupBy("session_key", "task_id").agg(
        F.max_by("est_id", F.struct("made_us", -c("est_id"))).alias("__winner"))
    ends = real.groupBy("session_key").agg(F.max("started_us").alias("__latest"))
    outcome = tasks.select("session_key", "task_id", "started_us", "last_us")
    joined = (near_rows.join(newest, ["session_key", "task_id"], "left").join(outcome, ["session_key", "task_id"], "left")
              .join(ends, "session_key", "left"))
    status = (F.when(c("task_id").isNotNull() & (F.coalesce("__taken", F.lit(False)) | (c("__winner") != c("est_id"))), "superseded")
              .when(c("task_id").isNotNull(), "linked")
              .when(c("made_us").isNull() | (F.lit(now_us) - c("made_us") > LINK_US), "unmatched").otherwise("open"))
    done = (c("status") == "linked") & ((c("__latest") > c("started_us")) | (F.lit(now_us) - c("last_us") > FINISHED_US))
    return joined.withColumn("status", status).select(
        "est_id", "session_key", "made_us", "status", F.when(c("status") == "linked", c("task_id")).alias("task_id"),
        F.coalesce(done, F.lit(False)).alias("finished"))


def outcomes(settled: DataFrame, stats: DataFrame) -> DataFrame:
    """What happened, for estimates whose task is over; appended once and never recomputed."""
    cols = ("turns_main", "turns", "cost_p", "unpriced", "first_input", "first_cache_read", "family")
    return settled.filter("finished").join(stats.select("session_key", "task_id", *cols), ["session_key", "task_id"]).withColumnRenamed("family", "family_after")


def cache_as_said(cached: Column, read: Column, first_input: Column) -> Column:
    """Cold was cold below 10% of the input; warm was warm from 90% of what was said."""
    return F.when(cached == 0, read < 0.1 * first_input).otherwise(read >= 0.9 * cached)


def scorecard(estimates: DataFrame, done: DataFrame, last: int = 50) -> DataFrame:
    """How the last N finished estimates did. Estimates carry lo, p50, hi, spread, cost_lo, cost_p50, cost_hi,
    input_next, cached, family, family_source; the cut to N rows comes first, so one small table is summed."""
    rows = (done.join(estimates.drop("session_key", "made_us"), "est_id").orderBy(c("made_us").desc(), c("est_id").desc()).limit(last))
    cost = c("cost_p").cast("double") / 1e12
    has, good = c("p50").isNotNull(), c("p50").isNotNull() & ~c("spread")
    priced = good & c("cost_p50").isNotNull() & (c("unpriced") == 0)
    err = (c("first_input") - c("input_next")) / c("first_input")
    guess = c("family_source") != "declared"
    half = lambda x: F.round(F.percentile(x, F.lit(0.5)), 6)
    n = lambda cond: F.count(F.when(cond, 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), n(good).alias("with_interval"), n(has & c("spread")).alias("no_interval_spread"), n(~has).alias("no_history"),
        n(good & inside(c("lo"), c("turns_main"), c("hi"))).alias("turns_inside"),
        half(F.when(has, F.abs(c("turns_main") - c("p50")))).alias("turns_median_abs_error"),
        half(F.when(has & (c("p50") != 0), c("turns_main") / c("p50"))).alias("turns_median_ratio"),
        n(priced).alias("cost_scored"), n(priced & inside(c("cost_lo"), cost, c("cost_hi"))).alias("cost_inside"),
        half(F.when(priced & (c("cost_p50") != 0), cost / c("cost_p50"))).alias("cost_median_ratio"),
        half(F.when(c("first_input") != 0, err)).alias("input_median_error"), n(F.abs(err) <= 0.05).alias("input_within_5pct"),
        n(cache_as_said(c("cached"), c("first_cache_read"), c("first_input"))).alias("cache_as_said"),
        n(guess).alias("family_guessed"), n(guess & (c("family") == c("family_after"))).alias("family_same_after"))


def computed_backtest(calls: DataFrame, prompt_chars: DataFrame, ratio: DataFrame) -> DataFrame:
    """Was the computed part right, for each prompt that followed a call of its session?

    `prompt_chars`: (source, task_id, chars). Errors, shares and gaps are real-valued: their
    percentiles are taken together, binned, by `exact_percentiles`.
    """
    pairs = call_pairs(calls).join(prompt_chars, ["source", "task_id"], "left")
    opens = ((c("trigger") == "user_turn") & c("tracked") & (c("prev.task_id") != c("task_id")) & ~c("after_compaction")
             & (c("input_total") >= 0.5 * c("prev.input_total")) & (c("prev.input_total") > 0)
             & c("t_us").isNotNull() & c("prev.t_us").isNotNull())
    rows = pairs.filter(opens).withColumn("ratio", ratio.select("ratio").scalar())
    predicted = c("prev.input_total") + c("prev.output") + F.bround(F.coalesce("chars", F.lit(0)) / c("ratio"), 0).cast("bigint")
    big = c("prev.input_total") >= 4096
    switch = c("model") != c("prev.model")
    cold = switch | (c("gap_us") > c("ttl") * SECOND_US)
    rows = rows.select(
        ((c("input_total") - predicted) / c("input_total")).alias("error"),
        F.when(big, c("cache_read") / c("prev.input_total")).alias("share"),
        F.when(big & cold, F.when(switch, "model").otherwise("idle")).alias("cold"), (big & ~cold).alias("warm"),
        (c("gap_us") / SECOND_US).alias("gap_s"), "ttl")
    missed = c("cold").isNotNull() & (c("share") >= 0.1)
    idle = missed & (c("cold") == "idle")
    n = lambda cond: F.count(F.when(cond, 1))
    counts = rows.agg(
        F.count(F.lit(1)).alias("prompts"), n(F.abs(c("error")) <= 0.05).alias("input_within_5pct"),
        n(c("cold").isNotNull()).alias("cold_said"), n(c("cold").isNotNull() & (c("share") < 0.1)).alias("cold_was_cold"),
        n(c("warm")).alias("warm_said"), n(c("warm") & (c("share") >= 0.9)).alias("warm_was_warm"),
        n(missed).alias("missed"), n(missed & (c("cold") == "model")).alias("missed_switch"),
        n(idle & (c("ttl") == 300)).alias("missed_idle_5m"), n(idle & (c("ttl") == 3600)).alias("missed_idle_1h"),
        n(missed & (c("share") >= 0.9)).alias("missed_fully_warm"),
        n(idle & (c("ttl") == 300) & (c("gap_s") <= 3600)).alias("missed_idle_5m_under_1h"))
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), x.alias("x")) for k, x in {
        "input_error": c("error"), "cold_share": F.when(c("cold").isNotNull(), c("share")), "warm_share": F.when(c("warm"), c("share")),
        "missed_share": F.when(missed, c("share")), "missed_gap_s": F.when(idle, c("gap_s"))}.items()])
    long = rows.select(F.explode(cells).alias("m")).select("m.*").filter(c("x").isNotNull())
    qs = exact_percentiles(long, ["measure"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    out = counts
    wanted = {"input_error": ("p10", "p50", "p90"), "cold_share": ("p50", "p90"), "warm_share": ("p50",), "missed_share": ("p50",),
              "missed_gap_s": ("p10", "p50", "p90")}
    flat = qs.agg(*[F.round(F.max(F.when(c("measure") == m, c(q))), 6).alias(f"{m}_{q}") for m, names in wanted.items() for q in names])
    return out.withColumn("__one", F.lit(1)).join(flat.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each

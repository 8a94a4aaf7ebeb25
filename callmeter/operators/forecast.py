"""What the next message costs: a batch of prompts against the history.

`prompts`: (prompt_id, session_key, made_us, chars, add_chars, model, family); model and family
are null unless given. Text stays outside; only its length is used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callmeter.functions.labels import TTL_SECONDS, rank_slice, ttl_of_write
from callmeter.functions.money import dollars, exact_sum
from callmeter.operators import neighbours
from callmeter.operators.cache import DEFAULT_TTL, SECOND_US, cache_events, call_pairs
from callmeter.operators.ordered import last_seen, merge, running_sum, scan, with_slices
from callmeter.operators.scores import INTERVAL, SPREAD_LIMIT
from callmeter.operators.tasks import by_prefix, main_calls
from callmeter.session import cut, dealt
from callmeter.sources.prices import PriceTable, with_prices

c = F.col
DEFAULT_CHARS_PER_TOKEN, MIN_CALIBRATION = 2.5, 10
MIN_FAMILY, MIN_RANK = 8, 30
LARGE_CONTEXT = 100_000
DEFAULT_MAX_OUTPUT = 32_000


def chars_per_token(calls: DataFrame) -> DataFrame:
    """One row (ratio, samples): characters added by large tool results per token the input grew."""
    pairs = call_pairs(calls)
    grew = c("input_total") - c("prev.input_total") - c("prev.output")
    fit = pairs.filter((c("trigger") == "tool_call") & (c("added_chars") >= 1000) & ~c("after_compaction") & (grew > 0))
    sums = fit.agg(F.sum("added_chars").alias("chars"), F.sum(grew).alias("tokens"), F.count(F.lit(1)).alias("samples"))
    ratio = F.least(F.lit(8.0), F.greatest(F.lit(1.5), c("chars") / c("tokens")))
    return sums.select(F.when(c("samples") >= MIN_CALIBRATION, ratio).otherwise(DEFAULT_CHARS_PER_TOKEN).alias("ratio"), "samples")


def pick_session(prompts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session of each prompt: id prefix, else the latest of its folder, else the latest of all.

    `sessions`: (session_key, session_id, cwd, last_us); `prompts` carry `prefix` and `cwd`, either may be null.
    """
    newest = F.max_by("session_key", F.struct("last_us", "session_key"))
    by_cwd = sessions.filter(c("cwd").isNotNull()).groupBy("cwd").agg(newest.alias("__here"))
    latest = sessions.agg(newest.alias("k")).scalar()
    given = by_prefix(sessions, "session_id", prompts).groupBy("prefix").agg(newest.alias("__given"))
    return prompts.join(by_cwd, "cwd", "left").join(given, "prefix", "left").withColumn(
        "session_key", F.when(c("prefix").isNotNull(), c("__given")).otherwise(F.coalesce(c("__here"), latest))).drop("__here", "__given")


def _write_price() -> Column:
    return F.when(c("ttl") == TTL_SECONDS["1h"], c("p_write_1h")).otherwise(c("p_write_5m"))


def next_input(prompts: DataFrame, calls: DataFrame, prices: PriceTable, ratio: DataFrame | None = None,
               rows: int | None = None) -> DataFrame:
    """Input of the call each prompt starts, what of it is still cached, and what that costs.

    The last main call before a prompt comes from one ordered pass over calls and prompts together.
    """
    factor = (ratio or chars_per_token(calls)).select("ratio").scalar()
    last = F.struct("t_us", "model", "input_total", "output", "task_id")
    history = main_calls(calls).select("session_key", "t_us", F.lit(0).alias("__ask"), "turn_id", "model", "input_total", "output",
                                    "task_id", "cache_write", "cache_write_1h")
    asks = prompts.select("session_key", c("made_us").alias("t_us"), F.lit(1).alias("__ask"), c("model").alias("asked_model"),
                          "prompt_id", "family", "chars", "add_chars")
    is_call = c("__ask") == 0
    found = scan(merge(history, asks, ["session_key"], "t_us", rows), ["session_key"], ["t_us", "__ask", "turn_id", "prompt_id"],
                 last=last_seen(F.when(is_call, last)),
                 ttl=last_seen(F.when(is_call, ttl_of_write(c("cache_write"), c("cache_write_1h")))))
    found = found.filter((c("__ask") == 1) & c("last").isNotNull()).select(
        "prompt_id", "session_key", c("t_us").alias("made_us"), "family", "chars", "add_chars",
        F.coalesce("asked_model", "last.model").alias("model"), "last", F.coalesce("ttl", F.lit(DEFAULT_TTL).cast("bigint")).alias("ttl"))
    tokens = lambda n: F.bround(F.coalesce(c(n), F.lit(0)) / c("ratio"), 0).cast("bigint")
    gap = c("made_us") - c("last.t_us")
    out = found.withColumn("ratio", factor).withColumns({"text_tokens": tokens("chars"), "file_tokens": tokens("add_chars"), "gap_us": gap})
    out = out.withColumn("input_next", c("last.input_total") + c("last.output") + c("text_tokens") + c("file_tokens"))
    same_model = c("model") == c("last.model")
    warm = same_model & (gap <= c("ttl") * SECOND_US)
    out = with_prices(out, prices).withColumns({"warm": F.coalesce(warm, F.lit(False)), "same_model": same_model})
    out = out.withColumn("cached", F.when(c("warm"), c("last.input_total")).otherwise(0)).withColumn("to_write", c("input_next") - c("cached"))
    return out.withColumns({
        "floor_p": c("cached") * c("p_read") + c("to_write") * _write_price(),
        "warm_p": c("last.input_total") * c("p_read") + (c("input_next") - c("last.input_total")) * _write_price()})


def histories(tasks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Past tasks once per basis they belong to: (kind, label, task_id, turns_main, turns)."""
    ranked = tasks.join(ranks.select("task_id", rank_slice(c("rank")).alias("rank_slice")), "task_id")
    cells = F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("label")),
                    F.struct(F.lit("family").alias("kind"), c("family").alias("label")),
                    F.struct(F.lit("rank").alias("kind"), c("rank_slice").alias("label")))
    return ranked.select("task_id", "turns_main", "turns", F.explode(cells).alias("b")).select("task_id", "turns_main", "turns", "b.*")


def choose_basis(asked: DataFrame, tasks: DataFrame, near: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Which past tasks each prompt is judged by, and the turns they took.

    First match: a declared family (with fewer than 8 past tasks: all), the nearest prompts, the same
    place in the session (30 or more), all. A session's running task is not history. Counts of past
    tasks per turn number stand in for the tasks, so no prompt is joined to every task.
    """
    # one narrow row per task; it is read several times below
    tasks = cut(tasks.select("session_key", "task_id", "started_us", "turns_main", "turns", "family"))
    if near is not None:
        qs = lambda n: F.percentile(c(n), F.array(*[F.lit(x) for x in INTERVAL.values()]))
        turns = tasks.select(c("task_id").alias("near_id"), "turns_main", "turns", F.lit(1).alias("__known"))
        # neighbours are many times the prompts: they are read once, and go to their prompt as rows, not as half-made percentiles
        near = cut(near.select("prompt_id", "near_id").join(dealt(turns), "near_id", "left").drop("near_id").repartition("prompt_id").groupBy("prompt_id").agg(
            F.count(F.lit(1)).alias("n_near"), qs("turns_main").alias("__qm"), qs("turns").alias("__qa"), F.nullif(F.count("__known"), F.lit(0)).alias("__n"),
            F.max("turns_main").alias("__mx")))
    ranks = scan(with_slices(tasks, ["session_key"], "started_us", rows), ["session_key"], ["started_us", "task_id"],
                 rank=running_sum(F.lit(1).cast("bigint")))
    past = histories(tasks, ranks)
    per_session = tasks.groupBy("session_key").agg(F.count(F.lit(1)).alias("__tasks"))
    own = past.groupBy("task_id").agg(F.max("turns_main").alias("__m"), F.max("turns").alias("__t"),
                                      F.max(F.when(c("kind") == "family", c("label"))).alias("__family"),
                                      F.max(F.when(c("kind") == "rank", c("label"))).alias("__slice"))
    sizes = past.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    q = (asked.withColumn("current", c("last.task_id")).join(per_session, "session_key", "left")
         .join(own.withColumnRenamed("task_id", "current"), "current", "left")
         .withColumn("rank_next", F.coalesce("__tasks", F.lit(0)) + 1))
    q = q.withColumn("slice_next", rank_slice(c("rank_next")))
    for kind, label, mine, name in (("family", "family", "__family", "n_family"), ("rank", "slice_next", "__slice", "n_rank")):
        side = sizes.filter(c("kind") == kind).select(c("label").alias(label), c("n").alias(f"__{name}"))
        q = q.join(side, label, "left").withColumn(
            name, F.coalesce(f"__{name}", F.lit(0)) - F.when(c(mine) == c(label), 1).otherwise(0)).drop(f"__{name}")
    if near is not None:
        q = q.join(dealt(near.select("prompt_id", "n_near")), "prompt_id", "left")
    else:
        q = q.withColumn("n_near", F.lit(None).cast("bigint"))
    declared = c("family").isNotNull()
    kind = (F.when(declared & (c("n_family") >= MIN_FAMILY), "family").when(declared, "all").when(c("n_near") > 0, "neighbours")
            .when(c("n_rank") >= MIN_RANK, "rank").otherwise("all"))
    q = q.withColumn("basis", kind).withColumn("label", F.when(kind == "family", c("family")).when(kind == "rank", c("slice_next")).otherwise("all"))
    counted = (c("basis") == "all") & c("__m").isNotNull() | (c("basis") == "family") & (c("__family") == c("label")) | \
        (c("basis") == "rank") & (c("__slice") == c("label"))
    q = cut(q.withColumns({"x_main": F.when(counted, c("__m")), "x_all": F.when(counted, c("__t"))}))

    def spread(measure: str, skip: str, names: dict[str, str]) -> DataFrame:
        hist = past.groupBy("kind", "label", measure).agg(F.count(F.lit(1)).alias("f"))
        wanted = q.filter("basis <> 'neighbours'").select(c("basis").alias("kind"), "label", F.coalesce(skip, F.lit(-1)).alias("__skip")).distinct()
        cells = wanted.join(hist, ["kind", "label"]).withColumn("f", c("f") - F.when(c(measure) == c("__skip"), 1).otherwise(0)).filter("f > 0")
        qs = F.percentile(c(measure), F.array(*[F.lit(x) for x in INTERVAL.values()]), c("f"))
        d = cells.groupBy("kind", "label", "__skip").agg(qs.alias("__q"), F.sum("f").alias(names["n"]), F.max(measure).alias(names["max"]))
        return d.select(c("kind").alias("basis"), "label", "__skip", c("__q").alias(names["q"]), names["n"], names["max"])

    main = spread("turns_main", "x_main", {"q": "qm", "n": "samples", "max": "max_turns"})
    every = spread("turns", "x_all", {"q": "qa", "n": "__na", "max": "__ma"}).drop("__na", "__ma")
    out = (q.withColumn("__skip", F.coalesce("x_main", F.lit(-1))).join(main, ["basis", "label", "__skip"], "left").drop("__skip")
           .withColumn("__skip", F.coalesce("x_all", F.lit(-1))).join(every, ["basis", "label", "__skip"], "left").drop("__skip"))
    if near is not None:
        out = out.join(dealt(near.drop("n_near")), "prompt_id", "left").withColumns({
            "qm": F.coalesce("qm", "__qm"), "qa": F.coalesce("qa", "__qa"), "samples": F.coalesce("samples", "__n"),
            "max_turns": F.coalesce("max_turns", "__mx")}).drop("__qm", "__qa", "__n", "__mx")
    names = list(INTERVAL)
    out = out.withColumns({**{n: c("qm")[i] for i, n in enumerate(names)}, **{f"all_{n}": c("qa")[i] for i, n in enumerate(names)}})
    return out.withColumn("spread", F.coalesce((c("hi") / c("lo")) >= SPREAD_LIMIT, c("lo").isNotNull())).drop(
        "qm", "qa", "__tasks", "__m", "__t", "__family", "__slice", "x_main", "x_all")


def nearest_tasks(asked: DataFrame, prompts: DataFrame, k: int = 30) -> DataFrame:
    """(prompt_id, near_id): the k earlier tasks whose prompts are most alike, for prompts that have k such; a session's running task isn't one.

    `asked` (prompt_id, last.task_id) with `prompts` (task_id, started_us, text) of all tasks; a prompt that is asked has the id of the task it opens.
    """
    lists = neighbours.nearest_lists(prompts, "task_id", "started_us", "text", k + 1)  # a row a prompt until the last step
    both = lists.select(c("task_id").alias("prompt_id"), c("best.near_id").alias("near")).join(dealt(asked.select("prompt_id", c("last.task_id").alias("__running"))), "prompt_id")
    kept = F.slice(F.filter("near", lambda x: ~x.eqNullSafe(c("__running"))), 1, k)
    return both.select("prompt_id", kept.alias("near")).filter(F.size("near") >= k).select("prompt_id", F.explode("near").alias("near_id"))


def frame(chosen: DataFrame, max_turns: int | None = None, max_output: int | None = None) -> DataFrame:
    """Cost of the likely turns, the floor, and the ceiling (every turn at its output limit)."""
    reread = c("input_next") * c("p_read")
    at = lambda n: dollars(c("floor_p") + F.greatest(c(n) - 1, F.lit(0.0)) * reread, 8)
    n = F.lit(max_turns).cast("bigint") if max_turns else F.coalesce("max_turns", F.lit(1).cast("bigint"))
    m = F.lit(max_output).cast("bigint") if max_output else F.coalesce("max_output", F.lit(DEFAULT_MAX_OUTPUT).cast("bigint"))
    out = chosen.withColumns({"ceiling_turns": n, "ceiling_output_per_turn": m}).withColumns({
        "ceiling_input": c("ceiling_turns") * c("input_next") + F.expr("ceiling_output_per_turn * ceiling_turns * (ceiling_turns - 1) div 2"),
        "ceiling_output": c("ceiling_turns") * c("ceiling_output_per_turn")})
    big = lambda x: c(x).cast("decimal(20,0)")
    ceiling = big("ceiling_input") * _write_price() + big("ceiling_output") * c("p_out")
    return out.withColumns({"floor_cost": dollars(c("floor_p"), 8), "ceiling_cost": dollars(ceiling, 8),
                            **{f"cost_{n}": at(n) for n in INTERVAL}})


def cost_state(asked: DataFrame, expired: DataFrame) -> DataFrame:
    """Warm, expired, switched model or unknown time; after an expiry, what past expiries of the model still read."""
    # reads are whole tokens below the context size
    past = expired.groupBy("model").agg(F.count(F.lit(1)).alias("past_expiries"), F.percentile("read", F.lit(0.5)).alias("__read"))
    state = (F.when(~c("same_model"), "model switch").when(c("gap_us").isNull(), "unknown time").when(~c("warm"), "expired").otherwise("warm"))
    out = asked.withColumn("state", state).join(past.filter(c("past_expiries") >= MIN_CALIBRATION), "model", "left")
    kept = F.when(c("state") == "expired", F.least(F.floor("__read"), c("input_next")))
    return out.withColumn("kept_tokens", kept).select(
        "prompt_id", "session_key", "state", F.when(c("state") == "warm", F.round((c("ttl") * SECOND_US - c("gap_us")) / SECOND_US, 3)).alias("left_s"),
        "input_next", dollars(c("floor_p"), 8).alias("cost"), dollars(c("warm_p"), 8).alias("warm_cost"), "kept_tokens",
        dollars(c("kept_tokens") * c("p_read") + (c("input_next") - c("kept_tokens")) * _write_price(), 8).alias("kept_cost"))


def warning_flags(asked: DataFrame, pairs: DataFrame, unused: DataFrame, family_share: DataFrame) -> DataFrame:
    """Per prompt: earlier breaks of its session, a large context, idle files, families that lean on sub-agents."""
    breaks = cache_events(pairs).filter("kind = 'break'").groupBy("session_key").agg(
        F.count(F.lit(1)).alias("breaks"), dollars(F.coalesce(exact_sum("extra_p"), F.lit(0)), 4).alias("break_cost"))
    out = (asked.join(breaks, "session_key", "left").join(unused.select("session_key", "loaded", "unused", "flagged"), "session_key", "left")
           .join(family_share, "family", "left"))
    return out.select("prompt_id", "session_key", F.coalesce("breaks", F.lit(0)).alias("breaks"), F.coalesce("break_cost", F.lit(0.0)).alias("break_cost"),
                      (c("input_next") > LARGE_CONTEXT).alias("large_context"), F.coalesce("flagged", F.lit(False)).alias("unused_files"),
                      F.coalesce(c("sub_share") >= 30, F.lit(False)).alias("leans_on_subagents"))


def family_sub_share(stats: DataFrame) -> DataFrame:
    """Percentage of each family's tokens spent by sub-agents."""
    return stats.groupBy("family").agg(F.sum("sub_tokens").alias("s"), F.sum("tokens").alias("t")).select(
        "family", F.when(c("t") > 0, 100 * c("s") / c("t")).otherwise(0.0).alias("sub_share"))

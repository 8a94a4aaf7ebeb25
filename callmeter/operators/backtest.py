"""Leak-free backtests: what each task would have been told by the tasks before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from callmeter.functions.money import PICO
from callmeter.operators.ordered import last_seen, scan
from callmeter.operators.quantiles import expanding_quantiles
from callmeter.operators.scores import (
    INTERVAL, MIN_BASIS, NOMINAL, SPREAD_LIMIT, bootstrap, five_numbers, inside, interval_metrics, interval_score)
from callmeter.operators.tasks import main_calls
from callmeter.session import cut

c = F.col
ORDER = ["started_us", "task_id"]
DECILES = {"lo": 0.1, "mid": 0.5, "hi": 0.9}
MIN_SLICE = 30


def leak_free(tasks: DataFrame, target: str, qs: dict[str, float] = DECILES, by: list[str] | None = None,
              whole: bool = True, rows: int | None = None, min_history: int = MIN_BASIS) -> DataFrame:
    """Tasks with at least `min_history` earlier ones (in their group), and the quantiles those give."""
    return expanding_quantiles(tasks, target, ORDER, qs, by, whole, rows).filter(c("n_before") >= min_history)


def turn_items(tasks: DataFrame, rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    qs = {"lo": INTERVAL["lo"], "mid": INTERVAL["p50"], "hi": INTERVAL["hi"]}
    narrow = tasks.select("session_key", "task_id", "started_us", c("turns_main").alias("y"), *(by or []))
    done = leak_free(narrow, "y", qs, by, True, rows)
    return done.withColumn("spread", F.coalesce(c("hi") / c("lo") >= SPREAD_LIMIT, F.lit(False)))


def backtest_turns(tasks: DataFrame, rows: int | None = None) -> DataFrame:
    """Turn intervals from every earlier task, and from earlier tasks of the same family."""
    tasks = cut(tasks.select("session_key", "task_id", "started_us", "turns_main", F.coalesce("family", F.lit("?")).alias("family")))
    every = turn_items(tasks, rows).withColumn("basis", F.lit("all"))
    family = turn_items(tasks, rows, ["family"]).withColumn("basis", F.lit("family")).drop("family")
    both = every.unionByName(family)
    spread = both.groupBy("basis").agg(F.count(F.when(c("spread"), 1)).alias("spread"))
    scored = interval_metrics(both.filter(~c("spread")), ["basis"])
    return spread.join(scored, "basis", "left")


def sliced(labels: DataFrame, qs: dict[str, float] = DECILES, rows: int | None = None,
           baseline: DataFrame | None = None) -> DataFrame:
    """Paired intervals per sign: from earlier tasks of the same slice (30 or more) or else from all earlier ones.

    `labels` is long: (sign, label, session_key, task_id, started_us, y). The baseline of a sign is fed by
    the tasks that have a value for it, unless `baseline` (all tasks: task_id, started_us, y) is given.
    """
    names = list(qs)
    labels = cut(labels.select("sign", "label", "session_key", "task_id", "started_us", "y"))
    own = expanding_quantiles(labels, "y", ORDER, {f"s_{n}": q for n, q in qs.items()}, ["sign", "label"], True, rows)
    own = own.withColumnRenamed("n_before", "n_slice")
    base_q = {f"b_{n}": q for n, q in qs.items()}
    if baseline is None:
        base = expanding_quantiles(labels.select("sign", "task_id", "started_us", "y"), "y", ORDER, base_q, ["sign"], True, rows)
        joined = own.join(base.drop("started_us", "y"), ["sign", "task_id"])
    else:
        base = expanding_quantiles(baseline.select("task_id", "started_us", "y"), "y", ORDER, base_q, None, True, rows)
        joined = own.join(base.drop("started_us", "y"), "task_id")
    enough = c("n_slice") >= MIN_SLICE
    return joined.filter(c("n_before") >= MIN_BASIS).withColumns({
        **{n: F.when(enough, c(f"s_{n}")).otherwise(c(f"b_{n}")) for n in names}, "fell_back": ~enough,
    }).drop(*[f"s_{n}" for n in names])


def judge_signs(pairs: DataFrame) -> DataFrame:
    """Per sign: scores with and without it, the paired gain with its session interval, and whether it passes."""
    y = c("y")
    gain = interval_score(c("lo"), y, c("hi")) - interval_score(c("b_lo"), y, c("b_hi"))
    scored = pairs.withColumns({"gain": gain, "covered": inside(c("lo"), y, c("hi")).cast("double")})
    sums = scored.groupBy("sign").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(c("fell_back"), 1)).alias("fell_back"),
        F.round(F.avg("covered"), 6).alias("coverage"), F.round(F.avg("gain"), 6).alias("gain"))
    ci = bootstrap(scored, ["sign"], means=("gain",), medians=())
    ok = (c("gain_hi") < 0) & c("coverage").between(0.75, 0.85)
    return sums.join(ci, "sign", "left").withColumn("passes", F.coalesce(ok, F.lit(False)))


KS = (1, 2, 3, 5, 10)


def turns_ahead_items(tasks: DataFrame, ks: tuple[int, ...] = (0, *KS), rows: int | None = None) -> DataFrame:
    """Turns still ahead after k turns, with the interval from earlier tasks that had also reached k."""
    reached = (tasks.select("session_key", "task_id", "started_us", "turns_main",
                            F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
               .filter(c("turns_main") >= F.greatest(c("k"), F.lit(1)))
               .withColumn("y", c("turns_main") - c("k")).drop("turns_main"))
    return leak_free(reached, "y", DECILES, ["k"], True, None if rows is None else rows * len(ks))


def survival(tasks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Of the tasks that made k turns: how many more they made, and how many ended right there."""
    reached = (tasks.select("turns_main", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
               .filter(c("turns_main") >= c("k")).withColumn("ahead", c("turns_main") - c("k")))
    ends = reached.groupBy("k").agg(F.count(F.when(c("ahead") == 0, 1)).alias("ends_at_k"))
    return five_numbers(reached, ["k"], "ahead").join(ends, "k")


# ------------------------------------------------------------------ interval recalibration

PAIRS = (5, 7.5, 10, 12.5, 15, 17.5, 20, 22.5, 25)


def recalibration(tasks: DataFrame, rows: int | None = None) -> DataFrame:
    """Nine symmetric intervals: coverage on the whole history and on each half, and the pair the older half picks."""
    qs = {f"q{i}": q / 100 for i, q in enumerate([*PAIRS, 50, *[100 - q for q in PAIRS]])}
    narrow = tasks.select("session_key", "task_id", "started_us", c("turns_main").alias("y"))
    done = leak_free(narrow, "y", qs, None, True, rows)
    mid = len(PAIRS)
    cells = F.array(*[F.struct(F.lit(float(q)).alias("q"), c(f"q{i}").alias("lo"), c(f"q{mid + 1 + i}").alias("hi"))
                      for i, q in enumerate(PAIRS)])
    size = done.agg(F.count(F.lit(1)).alias("m"))
    # every task counts for later ones, so n_before - MIN_BASIS numbers the scored tasks
    older = (c("n_before") - MIN_BASIS) < F.floor(size.select("m").scalar() / 2)
    long = done.withColumn("older", older).select(
        "session_key", "older", "y", c(f"q{mid}").alias("mid"), F.explode(cells).alias("x")).select("*", "x.*").drop("x")
    hit = inside(c("lo"), c("y"), c("hi")).cast("double")
    tab = long.groupBy("q").agg(F.round(F.avg(hit), 6).alias("coverage"),
                                F.avg(F.when(c("older"), hit)).alias("older_coverage"))
    newer = interval_metrics(long.filter(~c("older")), ["q"]).select(
        "q", c("n").alias("newer_n"), c("coverage").alias("newer_coverage"), c("interval_score").alias("newer_score"),
        c("width").alias("newer_width"))
    nine = Window.orderBy(F.round(F.abs(c("older_coverage") - NOMINAL), 9), "q")  # nine rows
    return (tab.join(newer, "q", "left").withColumn("chosen", F.row_number().over(nine) == 1)
            .withColumn("older_coverage", F.round("older_coverage", 6)))


# ------------------------------------------------------------------ cost


def priced_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with a priced first call, money in dollars."""
    usd = lambda n: c(n).cast("double") / PICO
    return (tasks.filter((c("floor_p") > 0) & (c("cost_p") > 0))
            .select("session_key", "task_id", "started_us", c("turns_main").alias("turns"), "first_input",
                    usd("cost_p").alias("cost"), usd("floor_p").alias("floor"), usd("reread_p").alias("reread")))


def cost_by_turns(floor, reread, n, extra=None):
    n = F.greatest(n, F.lit(1.0))
    flat = floor + (n - 1) * reread
    return flat if extra is None else flat + extra * (n - 1) * n / 2


def growth(calls: DataFrame) -> DataFrame:
    """Tokens each main call added to the context of its task, the previous answer left out.

    One row per consecutive pair of a task's main calls; compactions and halved contexts are skipped.
    """
    prev = F.struct("input_total", "output")
    # keyed by session and task: a session's slices cut its tasks at the same places
    rows = scan(main_calls(calls), ["session_key", "source", "task_id"], ["t_us", "turn_id"], prev=last_seen(prev))
    keep = ~c("after_compaction") & (c("input_total") >= 0.5 * c("prev.input_total"))
    return rows.filter(c("prev").isNotNull() & keep).select(
        "session_key", "source", "task_id", "turn_id", "t_us",
        (c("input_total") - c("prev.input_total") - c("prev.output")).alias("grew"))


def median_growth_before(tasks: DataFrame, grew: DataFrame, rows: int | None = None) -> DataFrame:
    """Per task, the median growth per turn over all earlier tasks (0 with none).

    Growth rows take their task's place in the order, after the task's own question.
    """
    place = tasks.select("task_id", "started_us")
    asks = place.withColumn("turn_id", F.lit(-1).cast("bigint")).withColumn("grew", F.lit(None).cast("double"))
    rows_in = grew.join(place, "task_id").select("task_id", "started_us", "turn_id", c("grew").cast("double").alias("grew"))
    both = asks.unionByName(rows_in.withColumn("turn_id", c("turn_id").cast("bigint")))
    found = expanding_quantiles(both, "grew", ["started_us", "task_id", "turn_id"], {"g": 0.5}, None, True, rows)
    return found.filter("turn_id = -1").select("task_id", F.coalesce("g", F.lit(0.0)).alias("growth"))


def cost_methods(tasks: DataFrame, grew: DataFrame, rows: int | None = None) -> DataFrame:
    """Four ways to put an interval on a task's cost, on the same tasks: long (method, session_key, lo, y, hi, mid)."""
    base = cut(priced_tasks(tasks).withColumn("ratio", c("cost") / c("floor")))  # one narrow row per task, read four times
    turns = leak_free(base, "turns", {"t_lo": 0.1, "t_mid": 0.5, "t_hi": 0.9}, None, True, rows)
    ratio = leak_free(base.select("task_id", "started_us", "ratio"), "ratio", {"r_lo": 0.1, "r_mid": 0.5, "r_hi": 0.9}, None, False, rows)
    direct = leak_free(base.select("task_id", "started_us", "cost"), "cost", {"d_lo": 0.1, "d_mid": 0.5, "d_hi": 0.9}, None, False, rows)
    per_turn = median_growth_before(base, grew, None if rows is None else 2 * rows)
    both = (turns.drop("n_before").join(ratio.drop("n_before", "started_us", "ratio"), "task_id")
            .join(direct.drop("n_before", "started_us", "cost"), "task_id").join(per_turn, "task_id"))
    more = c("reread") / c("first_input") * c("growth")
    ways = {
        "turns x context": lambda n: cost_by_turns(c("floor"), c("reread"), c(f"t_{n}")),
        "turns x growing context": lambda n: cost_by_turns(c("floor"), c("reread"), c(f"t_{n}"), more),
        "ratio x first input": lambda n: c(f"r_{n}") * c("floor"),
        "direct": lambda n: c(f"d_{n}"),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("method"), *[f(n).alias(n) for n in ("lo", "mid", "hi")]) for k, f in ways.items()])
    return both.select("session_key", "task_id", c("cost").alias("y"), F.explode(cells).alias("x")).select("*", "x.*").drop("x")


def cost_correction(tasks: DataFrame, rows: int | None = None) -> DataFrame:
    """Today's cost interval, the same times the median earlier ratio, and the ratio's own spread."""
    base = priced_tasks(tasks)
    turns = leak_free(base, "turns", {"t_lo": 0.1, "t_mid": 0.5, "t_hi": 0.9}, None, True, rows).drop("n_before")
    raw = {n: cost_by_turns(c("floor"), c("reread"), c(f"t_{n}")) for n in ("lo", "mid", "hi")}
    turns = turns.withColumns({f"e_{n}": x for n, x in raw.items()}).withColumn("ratio", c("cost") / c("e_mid"))
    ratios = leak_free(turns, "ratio", {"r_lo": 0.1, "r_mid": 0.5, "r_hi": 0.9}, None, False, rows)
    ways = {
        "turns x context": {n: c(f"e_{n}") for n in raw},
        "x median earlier ratio": {n: c(f"e_{n}") * c("r_mid") for n in raw},
        "median x ratio spread": {n: c("e_mid") * c(f"r_{n}") for n in raw},
    }
    cells = F.array(*[F.struct(F.lit(k).alias("method"), *[x.alias(n) for n, x in cols.items()]) for k, cols in ways.items()])
    return ratios.select("session_key", "task_id", c("cost").alias("y"), F.explode(cells).alias("x")).select("*", "x.*").drop("x")

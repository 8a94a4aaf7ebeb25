"""Lost prompt caches: events, expiries, causes, and what other sessions kept warm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callmeter.functions import labels
from callmeter.functions.labels import MIN_CACHEABLE, TTL_SECONDS
from callmeter.functions.money import dollars, exact_sum
from callmeter.operators.ordered import SLICE, last_seen, merge, running_sum, scan, with_slices
from callmeter.operators.tasks import is_main, main_calls, pos

c = F.col
KEY = ["session_key"]
SECOND_US = 1_000_000
DEFAULT_TTL = TTL_SECONDS["5m"]


def call_pairs(calls: DataFrame, prefix_writes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Each main call with the main call before it and the cache lifetime in force then.

    The lifetime is the one of the last write up to the previous call. `prefix_writes`
    (session_key, t_us) adds `written`: a prefix file was written from the previous call
    up to, not including, this one. Everything comes out of one pass per session.
    """
    prev = F.struct("turn_id", "t_us", "input_total", "output", "model", "task_id",
                    *[n for n in ("subs_before",) if n in calls.columns])
    marked = main_calls(calls).withColumn("__mark", F.lit(0))
    specs = dict(prev=last_seen(F.when(c("__mark") == 0, prev)),
                 ttl=last_seen(F.when(c("__mark") == 0, labels.ttl_of_write(c("cache_write"), c("cache_write_1h")))))
    if prefix_writes is not None:
        keep = [n for n in (*KEY, "t_us", "slice") if n in prefix_writes.columns]
        marked = merge(marked, prefix_writes.select(*keep, F.lit(1).alias("__mark")), KEY, "t_us", rows)
        specs["__written_us"] = last_seen(F.when(c("__mark") == 1, c("t_us")))
    # at one instant calls come before writes: a write belongs to the call it follows
    out = scan(marked, KEY, ["t_us", "__mark", "turn_id"], **specs).filter(c("__mark") == 0)
    if prefix_writes is not None:
        out = out.withColumn("written", F.coalesce(c("__written_us") >= c("prev.t_us"), F.lit(False)))
    return (out.filter(c("prev").isNotNull())
            .withColumns({"ttl": F.coalesce("ttl", F.lit(DEFAULT_TTL).cast("bigint")),
                          "gap_us": F.coalesce(c("t_us") - c("prev.t_us"), F.lit(0))})
            .drop("__mark", "__written_us"))


def _kept_context() -> Column:
    """The previous input was worth caching and the context did not shrink since."""
    return ((c("prev.input_total") >= MIN_CACHEABLE) & ~c("after_compaction")
            & (c("input_total") >= 0.5 * c("prev.input_total")))


def _expired() -> Column:
    return c("gap_us") > c("ttl") * SECOND_US


def is_lost() -> Column:
    return _kept_context() & (c("cache_read") < 0.5 * c("prev.input_total"))


def cache_events(pairs: DataFrame) -> DataFrame:
    """Calls that should have read the previous input from cache and did not."""
    write_price = F.when(c("ttl") == TTL_SECONDS["1h"], c("p_write_1h")).otherwise(c("p_write_5m"))
    lost = c("prev.input_total") - c("cache_read")
    return pairs.filter(is_lost()).withColumns({
        "kind": F.when(_expired(), "expired").otherwise("break"),
        "lost_tokens": lost,
        "extra_p": lost * (write_price - c("p_read")),
    })


def cache_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.sum("lost_tokens").alias("lost_tokens"),
                                      dollars(F.coalesce(exact_sum("extra_p"), F.lit(0)), 4).alias("extra_cost"))


def expiries(pairs: DataFrame) -> DataFrame:
    """Calls after an idle longer than the lifetime, same model, whatever was still read."""
    return pairs.filter(
        (c("prev.input_total") >= MIN_CACHEABLE) & (c("model") == c("prev.model")) & ~c("after_compaction")
        & (c("input_total") >= 0.5 * c("prev.input_total"))
        & c("t_us").isNotNull() & c("prev.t_us").isNotNull() & _expired()
    ).select("session_key", "turn_id", "model", "t_us", "gap_us", "ttl",
             c("prev.input_total").alias("context"), c("cache_read").alias("read"), *[n for n in (SLICE,) if n in pairs.columns])


def ttl_in_force(calls: DataFrame) -> DataFrame:
    """Lifetime set by the last write of each session's main thread (5 minutes when it never wrote)."""
    ttl = labels.ttl_of_write(c("cache_write"), c("cache_write_1h"))
    return main_calls(calls).groupBy(*KEY).agg(
        F.coalesce(F.max_by(ttl, F.when(ttl.isNotNull(), pos())), F.lit(DEFAULT_TTL).cast("bigint")).alias("ttl"))


def cache_clock(calls: DataFrame, now_us: Column | int) -> DataFrame:
    """Per session at `now_us`: is the cache warm, seconds left, tokens a cold call would write."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    ttl = labels.ttl_of_write(c("cache_write"), c("cache_write_1h"))
    last = main_calls(calls).groupBy(*KEY).agg(
        F.coalesce(F.max_by(ttl, F.when(ttl.isNotNull(), pos())), F.lit(DEFAULT_TTL).cast("bigint")).alias("ttl"),
        F.max_by(F.struct("t_us", "model", "input_total", "output"), pos()).alias("last"))
    left = (c("ttl") * SECOND_US - (now - c("last.t_us"))) / SECOND_US
    return last.select(*KEY, "ttl", (left > 0).alias("warm"), F.round(F.greatest(left, F.lit(0.0)), 3).alias("left_s"),
                       (c("last.input_total") + c("last.output")).alias("tokens"), c("last.model").alias("model"))


def prefix_file_writes(files: DataFrame) -> DataFrame:
    return files.filter((c("action") == "write") & labels.is_prefix_file(c("path")))


def with_causes(pairs: DataFrame) -> DataFrame:
    """Pairs (with `written`) plus `is_break` and the visible cause of each break."""
    is_break = is_lost() & ~_expired()
    cause = F.when(c("model") != c("prev.model"), "model_switch").when(c("written"), "prefix_file_written").otherwise(
        "no_visible_cause")
    return pairs.withColumn("is_break", is_break).withColumn("cause", F.when(c("is_break"), cause))


def break_causes(pairs: DataFrame) -> DataFrame:
    events = cache_events(with_causes(pairs)).filter("is_break")
    return events.groupBy("cause").agg(F.count(F.lit(1)).alias("breaks"),
                                       dollars(F.coalesce(exact_sum("extra_p"), F.lit(0)), 4).alias("cost"))


def prefix_writes(pairs: DataFrame) -> DataFrame:
    """Prefix-file edits with a next call to look at, and how many of those calls lost their cache."""
    seen = c("written") & (c("prev.input_total") >= MIN_CACHEABLE) & ~c("after_compaction")
    return with_causes(pairs).agg(F.count(F.when(seen, 1)).alias("prefix_writes"),
                                  F.count(F.when(seen & c("is_break"), 1)).alias("prefix_writes_then_break"))


def other_session_active(calls: DataFrame, cases: DataFrame, rows: int | None = None) -> DataFrame:
    """For each case (session_key, model, t_us, ttl): did another session call the model in [t - ttl, t)?

    Not a range join: calls are folded to one row per (model, instant), and one pass in
    time order carries the latest earlier instant of *another* session to every instant.
    A model holding most calls is cut into slices like any other ordered group.
    """
    instants = calls.groupBy("model", "t_us").agg(F.min("session_key").alias("s"), F.max("session_key").alias("s_max"))
    instants = with_slices(instants, ["model"], "t_us", rows)
    many = c("s") != c("s_max")
    seen = scan(instants, ["model"], ["t_us"],
                one=last_seen(F.when(~many, F.struct("t_us", "s"))), many_us=last_seen(F.when(many, c("t_us"))))
    # where the session changes, the instant before the change is the latest one of another session
    seen = scan(seen, ["model"], ["t_us"],
                before_us=last_seen(F.when(~many & (c("one.s") != c("s")), c("one.t_us")), inclusive=True))
    at = seen.select("model", "t_us", "one", "many_us", "before_us")
    latest = F.greatest("many_us", F.when(c("one.s") != c("session_key"), c("one.t_us")).otherwise(c("before_us")))
    return (cases.join(at, ["model", "t_us"], "left")
            .withColumn("other_active", F.coalesce(latest >= c("t_us") - c("ttl") * SECOND_US, F.lit(False)))
            .drop("one", "many_us", "before_us"))


def expiry_survivors(cases: DataFrame) -> DataFrame:
    """What was still read after an expiry, with and without another session active.

    Reads are whole tokens below the model's context size, so the percentile state is bounded.
    """
    on, kept = c("other_active"), c("read") >= 0.1 * c("context")
    p = lambda col, q: F.percentile(col, F.lit(q))
    return cases.agg(
        F.count(F.lit(1)).alias("n"),
        p(c("read"), 0.1).alias("read_p10"), p(c("read"), 0.5).alias("read_p50"), p(c("read"), 0.9).alias("read_p90"),
        F.count(F.when(on, 1)).alias("other_active"), F.count(F.when(on & kept, 1)).alias("other_active_read10"),
        p(F.when(on, c("read")), 0.5).alias("other_active_read_p50"),
        F.count(F.when(~on, 1)).alias("alone"), F.count(F.when(~on & kept, 1)).alias("alone_read10"),
        p(F.when(~on, c("read")), 0.5).alias("alone_read_p50"))


def with_subs_before(calls: DataFrame) -> DataFrame:
    """Running count of sub-agent calls, main calls first at one instant."""
    sub = (~is_main()).cast("bigint")
    return scan(calls.withColumn("__sub", sub), KEY, ["t_us", "__sub", "turn_id"],
                subs_before=running_sum(c("__sub"))).drop("__sub")


def unexplained_breaks(pairs: DataFrame) -> DataFrame:
    return cache_events(with_causes(pairs)).filter(c("is_break") & (c("cause") == "no_visible_cause"))


def break_shape(pairs: DataFrame) -> DataFrame:
    """Unexplained breaks counted along several measures: (measure, bucket, breaks, cost).

    Needs `call_index` (0-based) and `calls_in_session` on the pairs.
    """
    found = unexplained_breaks(pairs)
    share = c("gap_us") / (c("ttl") * SECOND_US)
    grew = c("input_total") - c("prev.input_total") - c("prev.output")
    measures = {
        "version": c("version"),
        "first 3 calls": F.when(c("call_index") <= 3, "yes").otherwise("no"),
        "position decile": F.least(F.lit(9), F.floor(10 * c("call_index") / c("calls_in_session"))).cast("string"),
        "task": F.when(c("task_id") != c("prev.task_id"), "new").otherwise("same"),
        "sub-agents between": F.when(c("subs_before") > c("prev.subs_before"), "yes").otherwise("no"),
        "gap share of ttl": F.concat_ws(" ", F.concat(c("ttl").cast("string"), F.lit("s")), F.when(share < 0.1, "<10%")
                                        .when(share < 0.5, "10-50%").when(share < 0.9, "50-90%").otherwise("90-100%")),
        "tokens still read": F.when(c("cache_read") == 0, "0").when(c("cache_read").between(15000, 35000), "15k-35k")
        .when(c("cache_read") > 35000, ">35k").otherwise("other"),
        "context": F.when(grew >= 0, "grew").otherwise("shrank"),
    }
    pairs_of = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("bucket")) for k, v in measures.items()])
    return (found.select("extra_p", F.explode(pairs_of).alias("m")).groupBy("m.measure", "m.bucket")
            .agg(F.count(F.lit(1)).alias("breaks"), dollars(F.coalesce(exact_sum("extra_p"), F.lit(0)), 4).alias("cost")))


def tool_lift(pairs: DataFrame, tools: DataFrame) -> DataFrame:
    """How much likelier a tool is just before an unexplained break than before any call."""
    flagged = with_causes(pairs).select(
        "source", c("prev.turn_id").alias("turn_id"),
        F.coalesce(c("is_break") & (c("cause") == "no_visible_cause"), F.lit(False)).alias("hit"))
    sizes = flagged.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(c("hit"), 1)).alias("breaks"))
    used = tools.select("source", "turn_id", "name").distinct()
    counts = flagged.join(used, ["source", "turn_id"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("before_any"), F.count(F.when(c("hit"), 1)).alias("before_break"))
    n = counts.withColumns({"pairs": sizes.select("pairs").scalar(), "breaks": sizes.select("breaks").scalar()})
    lift = (c("before_break") / F.greatest(c("breaks"), F.lit(1))) / (c("before_any") / c("pairs"))
    return n.filter(c("before_break") > 0).select("name", "before_break", "before_any", F.round(lift, 6).alias("lift"))


def break_concentration(pairs: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Breaks and cost held by the sessions with most of them."""
    per = unexplained_breaks(pairs).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("breaks"), F.coalesce(exact_sum("extra_p"), F.lit(0)).alias("cost_p"))
    deepest = max(ks)
    by_count = per.orderBy(c("breaks").desc(), "session_key").limit(deepest)
    by_cost = per.orderBy(c("cost_p").desc(), "session_key").limit(deepest)
    rank = running_sum(F.lit(1).cast("bigint"))
    # both lists hold at most `deepest` rows
    n = scan(by_count.withColumn("o", -c("breaks")), [], ["o", "session_key"], rank=rank)
    m = scan(by_cost.withColumn("o", -c("cost_p")), [], ["o", "session_key"], rank=rank)
    steps = F.explode(F.array(*[F.lit(k) for k in ks]))
    left = n.select(steps.alias("top"), "rank", "breaks").filter("rank <= top").groupBy("top").agg(F.sum("breaks").alias("breaks"))
    right = m.select(steps.alias("top"), "rank", "cost_p").filter("rank <= top").groupBy("top").agg(
        dollars(F.sum("cost_p"), 4).alias("cost"))
    return left.join(right, "top")

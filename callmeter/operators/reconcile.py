"""Our sums against an independent cumulative counter.

`calls` carry `line`, their place in the session's main log (for a sub-agent call the
place of its launch, null when unlinked); `snapshots` are (session_key, line, model,
c_input, c_read, c_write, c_output), one row per model named at that place. Where calls
carry a `slice`, snapshots carry the one of the call before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.functions.labels import normal_model
from callmeter.operators.ordered import last_seen, running_sum, scan

c = F.col
KEY = ["session_key"]
OURS = {"o_input": "input_new", "o_read": "cache_read", "o_write": "cache_write", "o_output": "output"}
COUNTER = ("c_input", "c_read", "c_write", "c_output")


def _last(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(*KEY).agg(F.max("line").alias("last_line"))


def counter_checks(calls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per (session, model), the last snapshot against the calls logged before it; one-sided models show."""
    last = _last(snapshots)
    counter = (snapshots.join(last, KEY).filter(c("line") == c("last_line"))
               .groupBy(*KEY, normal_model(c("model")).alias("model")).agg(*[F.sum(n).alias(n) for n in COUNTER]))
    ours = (calls.join(last, KEY).filter(c("line") < c("last_line"))
            .groupBy(*KEY, normal_model(c("model")).alias("model"))
            .agg(*[F.sum(src).alias(n) for n, src in OURS.items()], F.sum("output_logged").alias("o_output_logged")))
    return counter.join(ours, [*KEY, "model"], "full_outer").fillna(0, [*COUNTER, *OURS, "o_output_logged"])


def coverage(calls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per session with a counter: calls compared, made after the counter, and not linked to a launch."""
    main = c("trigger") != "subagent"
    after = c("line") >= c("last_line")
    return calls.join(_last(snapshots), KEY).groupBy(*KEY).agg(
        F.count(F.when(c("line") < c("last_line"), 1)).alias("calls_covered"),
        F.count(F.when(main & after, 1)).alias("main_after"),
        F.count(F.when(~main & after, 1)).alias("sub_after"),
        F.count(F.when(c("line").isNull(), 1)).alias("sub_unlinked"))


def series(calls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """At each snapshot: calls before it, our running sums and the counter's, and the snapshot before it."""
    totals = snapshots.groupBy(*KEY, "line", *[n for n in ("slice",) if n in snapshots.columns]).agg(
        *[F.sum(n).alias(n) for n in COUNTER])
    keep = [n for n in ("slice",) if n in calls.columns]
    rows = calls.filter(c("line").isNotNull()).select(*KEY, "line", *keep, *OURS.values(), F.lit(1).cast("bigint").alias("__call"))
    marks = totals.withColumn("__call", F.lit(0).cast("bigint"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    sums = {n: running_sum(F.coalesce(c(src), F.lit(0))) for n, src in OURS.items()}
    at = scan(both, KEY, ["line", "__call"], calls=running_sum(c("__call")), **sums).filter("__call = 0")
    now = F.struct("calls", *OURS, *COUNTER)
    out = scan(at.select(*KEY, *keep, "line", "calls", *OURS, *COUNTER), KEY, ["line"], prev=last_seen(now))
    three = lambda p: c(p + "_input") + c(p + "_read") + c(p + "_write")
    was = lambda p: c(f"prev.{p}_input") + c(f"prev.{p}_read") + c(f"prev.{p}_write")
    out = out.withColumns({"ours": three("o"), "counter": three("c"),
                           "prev_ours": was("o"), "prev_counter": was("c")})
    grew = c("prev").isNotNull() & (c("counter") >= c("prev_counter"))
    return out.withColumns({"pair": grew, "restart": c("prev").isNotNull() & ~grew}).withColumns({
        "d_calls": F.when(c("pair"), c("calls") - c("prev.calls")),
        "d_ours": F.when(c("pair"), c("ours") - c("prev_ours")),
        "d_counter": F.when(c("pair"), c("counter") - c("prev_counter")),
        **{f"d_{n}": F.when(c("pair"), c(n) - c(f"prev.{n}")) for n in (*OURS, *COUNTER)},
    }).withColumn("delta", c("d_ours") - c("d_counter"))


def increments(series_df: DataFrame) -> DataFrame:
    """Per session, what both sides added between snapshots of one counting run."""
    first = F.min_by(c("counter") - c("ours"), c("line"))
    zero = lambda n: F.coalesce(F.sum(n), F.lit(0))
    return series_df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("snapshots"), F.count(F.when(c("pair"), 1)).alias("pairs"),
        zero("d_calls").alias("calls"), zero("d_ours").alias("ours"), zero("d_counter").alias("counter"),
        first.alias("offset"), F.count(F.when(c("restart"), 1)).alias("restarts"),
        *[zero(f"d_{n}").alias(f"run_{n}") for n in (*OURS, *COUNTER)])


def gap_shape(series_df: DataFrame) -> DataFrame:
    """How the gap moved between snapshots of one run: in a few places, or all along."""
    size = F.abs(c("delta"))
    moves = series_df.filter(c("pair") & (c("delta") != 0)).withColumn("__size", size)
    top2 = (moves.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(c("__size").desc(), "line")))
            .filter("rn <= 2").groupBy(*KEY).agg(F.sum("__size").alias("top2")))
    total = series_df.groupBy(*KEY).agg(
        F.count(F.when(c("pair"), 1)).alias("intervals"),
        F.count(F.when(c("pair") & (c("delta") != 0), 1)).alias("steps"),
        F.coalesce(F.sum(F.when(c("pair"), size)), F.lit(0)).alias("moved"),
        F.coalesce(F.sum(F.when(c("pair") & (c("delta") != 0), c("d_calls"))), F.lit(0)).alias("calls_in_steps"))
    kind = (F.when(c("intervals") == 0, "unknown")
            .when((c("intervals") < 3) & (c("steps") > 0), "too few intervals")
            .when(c("steps") == 0, "none")
            .when((c("steps") <= 2) | (c("top2") >= 0.9 * c("moved")), "concentrated")
            .otherwise("spread"))
    return (total.join(top2, KEY, "left").withColumn("kind", kind)
            .select(*KEY, "kind", F.when(c("kind") == "unknown", 0).otherwise(c("steps")).cast("bigint").alias("steps"),
                    F.when(c("kind") == "unknown", 0).otherwise(c("intervals")).cast("bigint").alias("intervals"),
                    "calls_in_steps"))


def suffix_match(calls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sessions whose last counter equals exactly the last n covered calls on three fields.

    The sums of the last n calls are the session's total minus the running sums before them,
    so one forward pass finds the smallest n.
    """
    last = _last(snapshots)
    final = snapshots.join(last, KEY).filter(c("line") == c("last_line"))
    spoken = calls.select(*KEY, normal_model(c("model")).alias("norm")).distinct()  # models some call names
    named = final.withColumn("norm", normal_model(c("model"))).join(spoken, [*KEY, "norm"], "left_semi")
    target = named.groupBy(*KEY).agg(*[F.sum(n).alias("t" + n[1:]) for n in COUNTER[:3]])
    whole = final.groupBy(*KEY).agg(*[F.sum(n).alias("all" + n[1:]) for n in COUNTER])
    covered = calls.join(last, KEY).filter(c("line") < c("last_line"))
    fields = {**OURS, "o_n": None}
    one = F.lit(1).cast("bigint")
    sums = {f"__{n}": running_sum(one if src is None else c(src), inclusive=False) for n, src in fields.items()}
    run = scan(covered, KEY, ["line", "t_us", "turn_id"], **sums)
    total = covered.groupBy(*KEY).agg(*[(F.sum(src) if src else F.count(one)).alias(n) for n, src in fields.items()])
    tail = run.join(total, KEY).join(target, KEY).select(
        *KEY, "t_us", *[(c(n) - c(f"__{n}")).alias(n) for n in fields], c("o_n").alias("of"), "t_input", "t_read", "t_write")
    hit = tail.filter((c("o_input") == c("t_input")) & (c("o_read") == c("t_read")) & (c("o_write") == c("t_write")))
    best = hit.groupBy(*KEY).agg(F.min_by(F.struct("o_n", "of", "t_us", *OURS), c("o_n")).alias("m"))
    return best.join(whole, KEY).select(
        *KEY, c("m.o_n").alias("last_calls"), c("m.of").alias("of"), c("m.t_us").alias("since_us"),
        *[c(f"m.{n}").alias(f"tail_{n}") for n in OURS], *[c("all" + n[1:]).alias(f"tail_{n}") for n in COUNTER])


def totals_match(checks: DataFrame) -> DataFrame:
    """Per session: signed gaps, one-sided models, and whether input and cache agree summed over models."""
    ours = c("o_input") + c("o_read") + c("o_write")
    counter = c("c_input") + c("c_read") + c("c_write")
    same = [F.sum("o_" + f) == F.sum("c_" + f) for f in ("input", "read", "write")]
    return checks.groupBy(*KEY).agg(
        (same[0] & same[1] & same[2]).alias("exact"),
        F.sum(ours).alias("lines_input"), F.sum(counter).alias("counter_input"),
        *[F.sum(n).alias(n) for n in (*OURS, *COUNTER, "o_output_logged")],
        F.count(F.when((ours == 0) & (counter != 0), 1)).alias("models_counter_only"),
        F.count(F.when((counter == 0) & (ours != 0), 1)).alias("models_lines_only"))


def session_status(calls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The verdict of every session that has a counter, with the figures it rests on."""
    steps = series(calls, snapshots)
    return verdict(totals_match(counter_checks(calls, snapshots)), increments(steps), gap_shape(steps),
                   suffix_match(calls, snapshots))


def verdict(totals: DataFrame, inc: DataFrame, shape: DataFrame, suffix: DataFrame) -> DataFrame:
    """exact > lines_exact / run_exact > over > spread > increments_ok > restart > single."""
    status = (F.when(c("exact"), "exact")
              .when(c("last_calls") == c("of"), "lines_exact").when(c("last_calls").isNotNull(), "run_exact")
              .when((c("pairs") > 0) & (c("ours") > c("counter")), "over")
              .when((c("pairs") > 0) & (c("kind") == "spread"), "spread")
              .when(c("pairs") > 0, "increments_ok")
              .when(c("restarts") > 0, "restart").otherwise("single"))
    return (totals.join(inc, KEY, "left").join(shape.select(*KEY, "kind"), KEY, "left").join(suffix, KEY, "left")
            .withColumn("status", status))


def floor_gap(status: DataFrame) -> DataFrame:
    """What call lines miss, per field, where both sides cover the same calls."""
    def pick(n: str) -> Column:
        return (F.when(c("status").isin("exact", "lines_exact"), c(n))
                .when(c("status") == "run_exact", c(f"tail_{n}"))
                .when((c("status") == "increments_ok") & (c("pairs") > 0), c(f"run_{n}")))
    fields = ("input", "read", "write", "output")
    rows = status.select(*KEY, "status", *[pick("o_" + f).alias("o_" + f) for f in fields],
                         *[pick("c_" + f).alias("c_" + f) for f in fields]).filter(c("o_input").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("sessions"), *[F.sum("o_" + f).alias("lines_" + f) for f in fields],
                    *[F.sum(c("c_" + f) - c("o_" + f)).alias("gap_" + f) for f in fields])


def gaps(status: DataFrame) -> DataFrame:
    """Sessions that disagree, largest relative gap first is up to the caller."""
    diff = c("lines_input") - c("counter_input")
    return status.filter(~c("exact")).select(
        *KEY, "status", diff.alias("input_gap"),
        F.when(c("counter_input") != 0, F.round(100 * diff / c("counter_input"), 4)).alias("input_gap_pct"),
        (c("o_output") - c("c_output")).alias("output_gap"), "kind", "restarts")


STATUSES = ("exact", "lines_exact", "run_exact", "over", "spread", "increments_ok", "restart", "single")


def summary(status: DataFrame, sessions: int | Column) -> DataFrame:
    """One row: sessions by status, and the verdict on all of them together.

    `verified` needs every session of the period to have a counter that matches with every model on both sides.
    """
    n = F.lit(sessions) if isinstance(sessions, int) else sessions
    counts = status.agg(F.count(F.lit(1)).alias("checkable"),
                        *[F.count(F.when(c("status") == s, 1)).alias(s) for s in STATUSES],
                        F.coalesce(F.sum("models_counter_only"), F.lit(0)).alias("models_counter_only"),
                        F.coalesce(F.sum("models_lines_only"), F.lit(0)).alias("models_lines_only"))
    partly = (c("increments_ok") + c("single") + c("restart") + c("run_exact") + c("lines_exact")
              + c("models_counter_only") + c("models_lines_only")) > 0
    banner = (F.when(c("checkable") == 0, "not verified").when(c("over") > 0, "could not verify: over")
              .when(c("spread") > 0, "could not verify: spread")
              .when(partly | (c("checkable") < c("sessions")), "partly verified").otherwise("verified"))
    return counts.withColumn("sessions", n).withColumn("verdict", banner)


def one_sided_models(checks: DataFrame) -> DataFrame:
    """Models only one side names, over all sessions."""
    ours = c("o_input") + c("o_read") + c("o_write")
    counter = c("c_input") + c("c_read") + c("c_write")
    side = F.when((ours == 0) & (counter != 0), "counter").when((counter == 0) & (ours != 0), "lines")
    return checks.withColumn("side", side).filter(c("side").isNotNull()).groupBy("side", "model").agg(
        F.count(F.lit(1)).alias("sessions"))


def diagnosis(checks: DataFrame, session_prefix: str) -> DataFrame:
    """One session (by id or by the start of its hash), field by field: counter, ours, difference."""
    key = c("session_key").cast("string")
    mine = checks.filter(key.startswith(session_prefix) | F.sha2(key, 256).startswith(session_prefix))
    return unpivoted(mine)


def unpivoted(checks: DataFrame) -> DataFrame:
    fields = ("input", "read", "write", "output")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c("c_" + f).alias("counter"), c("o_" + f).alias("ours")) for f in fields])
    return checks.select(*KEY, "model", F.explode(cells).alias("x")).select(
        *KEY, "model", "x.field", "x.counter", "x.ours", (c("x.ours") - c("x.counter")).alias("difference"))


def by_version(status: DataFrame, sessions: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Per log version: sessions, how many have a counter, how many match, output missing from lines."""
    joined = sessions.join(status.select(*KEY, "exact", (c("c_output") - c("o_output")).alias("__gap")), KEY, "left")
    out = joined.groupBy("version").agg(
        F.count(F.lit(1)).alias("sessions"), F.count("exact").alias("checkable"),
        F.count(F.when(c("exact"), 1)).alias("exact"), F.coalesce(F.sum("__gap"), F.lit(0)).alias("output_gap"))
    if outcomes is not None:
        lost = outcomes.filter(c("bucket").isin("unreadable", "unknown_type")).groupBy("version").agg(
            F.sum("n").alias("not_understood"))
        out = out.join(lost, "version", "left").fillna(0, ["not_understood"])
    return out


def by_single_version(status: DataFrame, session_versions: DataFrame) -> DataFrame:
    """Verdict counts over the sessions that ran on one version only; `session_versions` is (session, version)."""
    single = session_versions.groupBy(*KEY).agg(F.countDistinct("version").alias("n"), F.min("version").alias("version")).filter("n = 1")
    return (status.join(single, KEY).groupBy("version").pivot("status", list(STATUSES)).count()
            .fillna(0))

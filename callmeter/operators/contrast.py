"""What happened between two consecutive expiries that read the same, against those that did not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callmeter.operators.ordered import last_seen, merge, next_seen, scan

c = F.col
BLOCK_READ = 60_000
CHANGES = {"version": "version changed", "model": "model changed", "cwd": "working directory changed", "branch": "git branch changed"}


def expiry_pairs(expiries: DataFrame) -> DataFrame:
    """Consecutive expiries of a (session, model) that both read a block, not a whole context."""
    rows = scan(expiries, ["session_key", "model"], ["t_us", "turn_id"], prev=last_seen(F.struct("t_us", "read")))
    return rows.filter((c("prev.read") <= BLOCK_READ) & (c("read") <= BLOCK_READ)).select(
        c("turn_id").alias("pair_id"), "session_key", "model", c("prev.t_us").alias("t0"), c("t_us").alias("t1"),
        F.abs(c("read") - c("prev.read")).alias("difference"), *[n for n in ("slice",) if n in rows.columns])


def events_between(pairs: DataFrame, marks: DataFrame, rows: int | None = None) -> DataFrame:
    """(pair_id, kind), distinct: kinds of marks with t0 < t <= t1, and what changed on the way.

    `marks`: (session_key, t_us, kind) and any of version, model, cwd, branch. Each mark is given to the
    next pair end of its session in one ordered pass per (session, model); no range join.
    """
    columns = [n for n in CHANGES if n in marks.columns]
    keep = [n for n in ("slice",) if n in marks.columns and n in pairs.columns]
    of = pairs.select("session_key", c("model").alias("for_model")).distinct()
    spread = marks.select("session_key", "t_us", "kind", *columns, *keep).join(of, "session_key").withColumn("__end", F.lit(0))
    ends = pairs.select("session_key", c("model").alias("for_model"), c("t1").alias("t_us"), F.lit(1).alias("__end"), "pair_id", "t0", *keep)
    both = scan(merge(spread, ends, ["session_key", "for_model"], "t_us", rows), ["session_key", "for_model"], ["t_us", "__end", "pair_id"],
                to=next_seen(F.when(c("__end") == 1, F.struct("pair_id", "t0"))))
    inside = both.filter((c("__end") == 0) & (c("t_us") > c("to.t0"))).select(c("to.pair_id").alias("pair_id"), "kind", *columns)
    kinds = inside.filter(c("kind").isNotNull()).select("pair_id", "kind").distinct()
    for n in columns:
        moved = inside.groupBy("pair_id").agg((F.min(n) != F.max(n)).alias("m")).filter("m")
        kinds = kinds.unionByName(moved.select("pair_id", F.lit(CHANGES[n]).alias("kind")))
    return kinds


def event_contrast(pairs: DataFrame, kinds: DataFrame, top: int = 25) -> DataFrame:
    """Per kind, how many pairs that stayed and that changed had it; largest difference of shares first."""
    same = c("difference") == 0
    sizes = pairs.agg(F.count(F.when(same, 1)).alias("s"), F.count(F.when(~same, 1)).alias("d"))
    counts = kinds.join(pairs.select("pair_id", "difference"), "pair_id").groupBy("kind").agg(
        F.count(F.when(same, 1)).alias("stayed"), F.count(F.when(~same, 1)).alias("changed"))
    full = counts.withColumns({"stayed_of": sizes.select("s").scalar(), "changed_of": sizes.select("d").scalar()})
    gap = F.abs(c("changed") / F.greatest("changed_of", F.lit(1)) - c("stayed") / F.greatest("stayed_of", F.lit(1)))
    return full.withColumn("gap", F.round(gap, 9)).orderBy(c("gap").desc(), "kind").limit(top).drop("gap")

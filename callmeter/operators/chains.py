"""Walks up the parent links of log lines, as joins that shrink as walks end."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from callmeter.session import cut, dealt

c = F.col
Merge = Callable[[dict[str, Column], dict[str, Column], Column], dict[str, Column]]
MAX_HOPS = 500
COMPACTION_HOPS = 50


def nearest_prompt(nodes: DataFrame) -> DataFrame:
    """(session_key, uuid, root_prompt) for every node: the first prompt id found going up, within 500 nodes.

    Pointer doubling: after round r a row points 2^r nodes up, so nine rounds cover any allowed chain,
    and only rows still open are joined. Each round is cut in the shared folder.
    """
    state = nodes.select(
        "session_key", "uuid", c("prompt_id").alias("root_prompt"),
        F.when(c("prompt_id").isNull(), c("parent")).alias("target"),
        F.when(c("prompt_id").isNull(), 1).otherwise(0).cast("bigint").alias("hops"))
    done = None
    for _ in range(9):
        state = cut(state)
        is_open = c("root_prompt").isNull() & c("target").isNotNull()
        if state.filter(is_open).isEmpty():
            break
        up = state.select("session_key", c("uuid").alias("target"), c("root_prompt").alias("__r"), c("target").alias("__t"),
                          c("hops").alias("__h"))
        moved = state.filter(is_open).join(dealt(up), ["session_key", "target"], "left").select(
            "session_key", "uuid", c("__r").alias("root_prompt"), c("__t").alias("target"),
            (c("hops") + F.coalesce("__h", F.lit(0))).alias("hops"))
        state = moved.unionByName(state.filter(~is_open))
    done = state.withColumn("root_prompt", F.when(c("hops") < MAX_HOPS, c("root_prompt")))
    return done.select("session_key", "uuid", "root_prompt")


class Lift:
    """Jumps of 1, 2, 4, ... nodes up the parent links, over nodes that let a walk pass, with what is gathered on the way.

    A level is one join of the level below with itself and holds only jumps of its full length, so levels end with the longest run of
    such nodes. A walk then takes each level once, longest first: a chain of n nodes costs log2(n) rounds to build and as many to climb.
    `values` are columns of a node; `merge(low, up, offset)` joins what two stretches gather, the upper one beginning `offset` nodes up.
    """

    def __init__(self, nodes: DataFrame, passes: Column, values: dict[str, Column], merge: Merge, limit: int):
        self.names, self.merge, self.limit = list(values), merge, limit
        level = cut(nodes.filter(passes).select("session_key", c("uuid").alias("at"), c("parent").alias("up"), *[x.alias(n) for n, x in values.items()]))
        self.levels = [level]
        while 2 ** len(self.levels) <= limit:
            width = 2 ** (len(self.levels) - 1)
            above = level.select("session_key", c("at").alias("up"), c("up").alias("__up"), *[c(n).alias(f"__{n}") for n in self.names])
            level = cut(level.join(dealt(above), ["session_key", "up"]).select("session_key", "at", c("__up").alias("up"), *self._merged(F.lit(width))))
            if level.isEmpty():
                break
            self.levels.append(level)

    def _merged(self, offset: Column, when: Column | None = None) -> list[Column]:
        both = self.merge({n: c(n) for n in self.names}, {n: c(f"__{n}") for n in self.names}, offset)
        return [(x if when is None else F.when(when, x).otherwise(c(n))).alias(n) for n, x in both.items()]

    def climb(self, walks: DataFrame) -> DataFrame:
        """walks (session_key, key, at, hops, values) moved up to the first node that lets nothing pass, or until `limit` nodes are behind them."""
        for k in reversed(range(len(self.levels))):
            step = self.levels[k].select("session_key", "at", c("up").alias("__up"), *[c(n).alias(f"__{n}") for n in self.names], F.lit(True).alias("__hit"))
            go = F.coalesce("__hit", F.lit(False)) & (c("hops") + 2**k <= self.limit)
            walks = walks.join(dealt(step), ["session_key", "at"], "left").select(
                "session_key", "key", F.when(go, c("__up")).otherwise(c("at")).alias("at"), (c("hops") + F.when(go, 2**k).otherwise(0)).alias("hops"),
                *self._merged(c("hops"), go))
        return cut(walks)


def _gathered(low: dict[str, Column], up: dict[str, Column], offset: Column) -> dict[str, Column]:
    return {"chars": low["chars"] + up["chars"], "ids": F.concat(low["ids"], up["ids"]), "first_us": F.coalesce(low["first_us"], up["first_us"])}


def _edge(low: dict[str, Column], up: dict[str, Column], offset: Column) -> dict[str, Column]:
    return {"edge": F.coalesce(low["edge"], up["edge"] + offset)}


def trigger_walk(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What set each call off, and the tool results on the way.

    `calls`: (session_key, key, parent). `nodes`: (session_key, uuid, parent, kind, chars, t_us, call, result_ids,
    boundary). Returns one row per call (outcome, has_ids, chars, trigger_us, after_compaction) and the long
    table (session_key, key, tool_use_id). A prompt ends a walk, so does a line of another call or a
    missing line; meta lines add their characters; everything else is passed through. Walks end after 500 nodes, the look for
    a compaction after 50.
    """
    nodes = cut(nodes)
    none = F.lit(None)
    result = c("kind") == "tool_result"
    lift = Lift(nodes, ~c("kind").isin("prompt", "assistant"), {
        "chars": F.when(c("kind").isin("tool_result", "meta"), c("chars")).otherwise(0).cast("bigint"),
        "ids": F.when(result, c("result_ids")).otherwise(F.array().cast("array<string>")),
        "first_us": F.when(result, c("t_us"))}, _gathered, MAX_HOPS)
    right = nodes.select("session_key", c("uuid").alias("at"), c("parent").alias("__up"), "kind", c("chars").alias("__chars"), c("t_us").alias("__t"), c("call").alias("__call"))
    walks = calls.select("session_key", "key", c("parent").alias("at"), F.lit(0).cast("bigint").alias("hops"), F.lit(0).cast("bigint").alias("chars"),
                         F.array().cast("array<string>").alias("ids"), none.cast("bigint").alias("first_us"))
    ends = None
    while True:  # once, and once more for each line of the call itself that stands above it
        here = cut(lift.climb(walks).join(dealt(right), ["session_key", "at"], "left"))
        own = F.coalesce((c("kind") == "assistant") & (c("__call") == c("key")), F.lit(False)) & (c("hops") < MAX_HOPS)
        ends = here.filter(~own) if ends is None else ends.unionByName(here.filter(~own))
        walks = here.filter(own).select("session_key", "key", c("__up").alias("at"), (c("hops") + 1).alias("hops"), "chars", "ids", "first_us")
        if walks.isEmpty():
            break
    over = c("at").isNull() | (c("hops") >= MAX_HOPS)
    asked = (c("kind") == "prompt") & (F.size("ids") == 0) & ~over
    outcome = F.when(over, none).when(F.coalesce(asked, F.lit(False)), "prompt").otherwise("end")
    found = ends.select("session_key", "key", (F.size("ids") > 0).alias("has_ids"), (c("chars") + F.when(asked, c("__chars")).otherwise(0)).alias("chars"),
                        F.when(asked, c("__t")).otherwise(c("first_us")).alias("trigger_us"), outcome.alias("outcome"))

    past = Lift(nodes, c("kind") != "assistant", {"edge": F.when(c("boundary"), F.lit(0).cast("bigint"))}, _edge, COMPACTION_HOPS)
    begun = calls.select("session_key", "key", c("parent").alias("at"), F.lit(0).cast("bigint").alias("hops"), none.cast("bigint").alias("edge"))
    compacted = past.climb(begun).select("session_key", "key", c("edge").isNotNull().alias("after_compaction"))
    return found.join(dealt(compacted), ["session_key", "key"]), ends.select("session_key", "key", F.explode("ids").alias("tool_use_id"))


def launched_tasks(calls: DataFrame, launcher: DataFrame) -> DataFrame:
    """calls (session_key, key, thread, task_id, ...) with the task of the call that launched their thread, or of that one's launcher, where they have none.

    Pointer doubling over launches: agents that launch agents d deep take log2(d) rounds. Calls whose launches lead nowhere keep no task.
    """
    calls = calls.join(launcher, ["session_key", "thread"], "left")
    waiting = -1
    while True:
        calls = cut(calls)
        open_ = c("task_id").isNull() & c("launch_key").isNotNull()
        before, waiting = waiting, calls.filter(open_).count()
        if waiting in (0, before):  # nothing left, or only launches in a ring
            return calls.drop("launch_key")
        up = calls.select("session_key", c("key").alias("launch_key"), c("task_id").alias("__task"), c("launch_key").alias("__up"))
        moved = calls.filter(open_).join(dealt(up), ["session_key", "launch_key"], "left").withColumns({"task_id": c("__task"), "launch_key": c("__up")}).drop("__task", "__up")
        calls = calls.filter(~open_).unionByName(moved)

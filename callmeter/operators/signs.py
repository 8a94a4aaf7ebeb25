"""Signs a task gives before it is sent and in its first turns, as long tables (task, sign, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.functions.labels import ladder, pseudonym, rank_slice, shell_slice
from callmeter.operators.ordered import last_seen, running_sum, scan
from callmeter.operators.scores import five_numbers
from callmeter.operators.tasks import AGENT_TOOLS, PLAN_TOOL, SHELL_TOOL, WRITE_TOOLS, main_calls

c = F.col
ORDER = ["started_us", "task_id"]
# fixed values: slash commands every installation has
BUILTIN_COMMANDS = ("review", "compact", "init", "clear", "security-review", "pr-comments", "model", "cost", "help", "config",
                    "memory", "resume", "context", "loop", "simplify", "code-review")
FIRST = "first of session"


def _long(df: DataFrame, signs: dict[str, Column], keep: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("sign"), v.cast("string").alias("label")) for k, v in signs.items()])
    return (df.select(*keep, F.explode(cells).alias("s")).filter(c("s.label").isNotNull())
            .select(*keep, "s.sign", "s.label"))


def _yes(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no")


def merge_followups(tasks: DataFrame) -> DataFrame:
    """Fold tasks opened by a short follow-up into the task before them; a session's first task stays."""
    opens = F.when(F.coalesce(c("followup"), F.lit(False)), 0).otherwise(1).cast("bigint")
    islands = scan(tasks, ["session_key"], ORDER, island=running_sum(opens))
    at = F.struct(*ORDER)
    return islands.groupBy("session_key", "island").agg(
        F.min_by("task_id", at).alias("task_id"), F.min("started_us").alias("started_us"),
        F.sum("turns_main").alias("turns_main"), F.sum("turns").alias("turns"), F.sum("cost_p").alias("cost_p"),
        F.count(F.lit(1)).alias("tasks")).drop("island")


def followup_study(tasks: DataFrame) -> DataFrame:
    """How many tasks are short follow-ups, how many open a session, and how many prompts are as short."""
    ranked = scan(tasks, ["session_key"], ORDER, rank=running_sum(F.lit(1).cast("bigint")))
    fu = F.coalesce(c("followup"), F.lit(False))
    return ranked.agg(
        F.count(F.lit(1)).alias("tasks"), F.count("chars").alias("with_prompt"), F.count(F.when(fu, 1)).alias("followups"),
        F.count(F.when(c("chars") <= 20, 1)).alias("short_prompts"),
        F.count(F.when(fu & (c("rank") == 1), 1)).alias("followup_first"),
        F.percentile(F.when(fu, c("turns_main")), F.lit(0.5)).alias("followup_turns_p50"),
        F.percentile("turns_main", F.lit(0.5)).alias("turns_p50"))


def pre_send_signs(tasks: DataFrame, top: int = 10) -> DataFrame:
    """Signs known before the prompt is sent; tasks carry prompt features (null without a prompt)."""
    ranked = scan(tasks, ["session_key"], ORDER, rank=running_sum(F.lit(1).cast("bigint")), before=last_seen(c("turns_main")))
    busiest = (tasks.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "project").limit(top)
               .select("project", F.lit(True).alias("__top")))
    joined = ranked.join(F.broadcast(busiest), "project", "left")  # `top` rows
    command = F.when(c("chars").isNull(), F.lit(None).cast("string")).when(c("command").isNull(), "none").when(
        F.lower(F.element_at(F.split("command", ":"), -1)).isin(*BUILTIN_COMMANDS), F.concat(F.lit("/"), c("command"))
    ).otherwise(F.concat(F.lit("custom "), pseudonym(c("command"), 6)))
    signs = {
        "previous task's turns": F.when(c("rank") == 1, FIRST).otherwise(
            ladder(c("before"), [(1, "1"), (3, "2-3"), (8, "4-8"), (20, "9-20")], "21+")),
        "first of session": F.when(c("rank") == 1, "first").otherwise("later"),
        "rank in session": rank_slice(c("rank")),
        "project": F.when(c("__top"), F.concat(F.lit("project "), pseudonym(c("project"), 6))).otherwise("other"),
        "model": c("first_model"),
        "short follow-up": _yes(c("followup")), "error pasted": _yes(c("error")),
        "prompt length": ladder(c("chars"), [(49, "<50"), (199, "50-199"), (999, "200-999")], "1000+"),
        "files mentioned": ladder(c("n_files"), [(0, "0"), (1, "1"), (3, "2-3")], "4+"),
        "slash command": command,
    }
    return _long(joined, signs, ["session_key", "task_id", "started_us", "turns_main"])


def task_tools(tools: DataFrame) -> DataFrame:
    """Per task: did it edit, did it launch sub-agents (main-thread tools)."""
    return tools.groupBy("source", "task_id").agg(
        F.bool_or(c("name").isin(*WRITE_TOOLS)).alias("edited"), F.bool_or(c("name").isin(*AGENT_TOOLS)).alias("launched"))


def context_signs(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """Idle time, what the previous task did, context at the start, how the prompt is written."""
    did = task_tools(tools)
    rows = tasks.join(did, ["source", "task_id"], "left").fillna(False, ["edited", "launched"])
    ranked = scan(rows, ["session_key"], ORDER, before=last_seen(F.struct("last_us", "edited", "launched")))
    idle = (c("started_us") - c("before.last_us")) / 1_000_000
    first = c("before").isNull()
    signs = {
        "idle since previous task": F.when(first, FIRST).otherwise(ladder(
            idle, [(60, "<1 min"), (300, "1-5 min"), (1800, "5-30 min"), (7200, "30 min-2 h")], "2 h+")),
        "previous task edited files": F.when(first, FIRST).otherwise(_yes(c("before.edited"))),
        "previous task launched sub-agents": F.when(first, FIRST).otherwise(_yes(c("before.launched"))),
        "context at start": ladder(c("first_input"), [(30_000, "<30k"), (60_000, "30-60k"), (120_000, "60-120k"),
                                                      (250_000, "120-250k")], "250k+"),
        "list items in prompt": ladder(c("n_items"), [(0, "0"), (2, "1-2"), (5, "3-5")], "6+"),
        "prompt is a question": _yes(c("question")),
    }
    return _long(ranked, signs, ["session_key", "task_id", "started_us", "turns_main"])


def first_calls(calls: DataFrame, k: int) -> DataFrame:
    """The first k main calls of each task; the cut runs before the shuffle."""
    at = Window.partitionBy("source", "task_id").orderBy("t_us", "turn_id")
    return (main_calls(calls).select("source", "task_id", "t_us", "turn_id")
            .withColumn("nth", F.row_number().over(at)).filter(c("nth") <= k))


def early_tools(calls: DataFrame, tools: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per task and k: what its first k main calls did."""
    first = first_calls(calls, max(ks))
    used = first.join(tools.select("source", "turn_id", "name"), ["source", "turn_id"], "left")
    each = used.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(c("nth") <= c("k"))
    return each.groupBy("source", "task_id", "k").agg(
        F.coalesce(F.bool_or(c("name").isin(*WRITE_TOOLS)), F.lit(False)).alias("edited"),
        F.coalesce(F.bool_or(c("name") == PLAN_TOOL), F.lit(False)).alias("planned"),
        F.coalesce(F.bool_or(c("name").isin(*AGENT_TOOLS)), F.lit(False)).alias("launched"),
        F.count(F.when(c("name") == SHELL_TOOL, 1)).alias("shell"))


def early_signs(tasks: DataFrame, calls: DataFrame, tools: DataFrame, ks: tuple[int, ...] = (2, 3), fine: bool = False) -> DataFrame:
    """Signs of the first k turns, for tasks that made k; the target is the turns still ahead."""
    did = early_tools(calls, tools, ks)
    rows = did.join(tasks.select("source", "task_id", "session_key", "started_us", "turns_main"), ["source", "task_id"]).filter(
        c("turns_main") >= c("k"))
    lead = lambda text: F.concat(F.lit("first "), c("k").cast("string"), F.lit(" turns: " + text))
    shell = shell_slice(c("shell")) if fine else ladder(c("shell"), [(0, "0"), (2, "1-2")], "3+")
    cells = F.array(
        F.struct(lead("edited a file").alias("sign"), _yes(c("edited")).alias("label")),
        F.struct(lead("planned").alias("sign"), _yes(c("planned")).alias("label")),
        F.struct(lead("launched a sub-agent").alias("sign"), _yes(c("launched")).alias("label")),
        F.struct(lead("shell commands").alias("sign"), shell.alias("label")))
    if fine:
        cells = F.slice(cells, 4, 1)
    return rows.select("session_key", "task_id", "started_us", "k", (c("turns_main") - c("k")).alias("y"),
                       F.explode(cells).alias("s")).select("*", "s.*").drop("s")


def top_labels(labels: DataFrame, value: str, n: int = 12) -> DataFrame:
    """Five-number summary of the n most common labels of each sign."""
    sums = five_numbers(labels, ["sign", "label"], value)
    order = Window.partitionBy("sign").orderBy(c("n").desc(), "label")
    return sums.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= n)

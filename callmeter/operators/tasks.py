"""From calls to priced calls and tasks: enrichment, per-task statistics, ranks, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.functions import labels
from callmeter.functions.money import call_cost, exact_sum
from callmeter.operators.ordered import running_sum, scan
from callmeter.sources.prices import with_prices

# fixed values: commands and tools that decide a task's family
REVIEW_COMMANDS = ("review", "code-review", "security-review", "pr-review", "pr-comments")
READ_TOOLS = ("Read", "NotebookRead")
WRITE_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
SEARCH_TOOLS = ("Grep", "Glob", "LS")
AGENT_TOOLS = ("Agent", "Task")
SHELL_TOOL = "Bash"
PLAN_TOOL = "TodoWrite"
# fixed value: shell commands that measure
MEASURE_PATTERN = (r"(?i)\b(bench\w*|hyperfine|time\s|timeit|perf\b|profil\w*|cProfile|py-spy|coverage|pytest\s.*--durations|wc\s|du\s|cloc|tokei|"
                   r"ccusage|lighthouse|ab\s|wrk\s)")

def pos() -> Column:
    return F.struct("t_us", "turn_id")


def is_main() -> Column:
    return F.col("trigger") != "subagent"


def main_calls(calls: DataFrame) -> DataFrame:
    return calls.filter(is_main())


def guess_family(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """Family of each task (source, task_id[, command]) from its command and first five main-thread tools.

    `tools` holds main-thread tool uses (source, task_id, t_us, turn_id, ord, name, command).
    The cut to five runs before the shuffle, so a task with millions of tool uses costs five rows.
    """
    first = Window.partitionBy("source", "task_id").orderBy("t_us", "turn_id", "ord")
    name = F.col("name")
    seen = (
        tools.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= 5)
        .groupBy("source", "task_id")
        .agg(
            F.bool_or(name.isin(*WRITE_TOOLS)).alias("__writes"),
            F.bool_or((name == SHELL_TOOL) & F.coalesce(F.col("command").rlike(MEASURE_PATTERN), F.lit(False))).alias("__measures"),
            (F.bool_and(name.isin(*READ_TOOLS, *SEARCH_TOOLS)) & (F.count(F.lit(1)) >= 3)).alias("__reads"),
        )
    )
    opened = F.col("command") if "command" in tasks.columns else F.lit(None).cast("string")
    review = F.lower(F.element_at(F.split(opened, ":"), -1)).isin(*REVIEW_COMMANDS)
    family = (
        F.when(review, "review").when(F.col("__writes"), "refactor").when(F.col("__measures"), "measure")
        .when(F.col("__reads"), "review").otherwise("question")
    )
    return (tasks.join(seen, ["source", "task_id"], "left").withColumn("family", family)
            .drop("__writes", "__measures", "__reads"))


def by_prefix(rows: DataFrame, name: str, asked: DataFrame) -> DataFrame:
    """rows once per length that the column `prefix` of `asked` has, with `prefix`, so that a prefix test is an equi join.

    There are no more lengths than a name has characters; longer prefixes fit no name.
    """
    lengths = asked.agg(F.collect_set(F.char_length("prefix")).alias("n")).scalar()
    long = rows.withColumn("__n", F.explode(lengths)).filter(F.col("__n") <= F.char_length(name))
    return long.withColumn("prefix", F.substring(F.col(name), F.lit(1), F.col("__n"))).drop("__n")


def resolve_tags(tasks: DataFrame, tags: DataFrame) -> DataFrame:
    """Declared families: (source, prefix, family, declared_at) -> (source, task_id, declared).

    A prefix counts only when exactly one task id starts with it; the last declaration of a task wins, of several at
    one time the last by name.
    """
    key = ["source", "prefix"]
    only = (by_prefix(tasks.select("source", "task_id").distinct(), "task_id", tags).groupBy(*key)
            .agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("task_id")).filter("n = 1").drop("n"))
    return tags.join(only, key).groupBy("source", "task_id").agg(F.max_by("family", F.struct("declared_at", "family")).alias("declared"))


def with_declared(tasks: DataFrame, declared: DataFrame) -> DataFrame:
    """A declared family wins over the guess, and says so."""
    return (
        tasks.join(declared, ["source", "task_id"], "left")
        .withColumn("family_source", F.when(F.col("declared").isNotNull(), "declared").otherwise("guessed"))
        .withColumn("family", F.coalesce("declared", "family")).drop("declared")
    )


def enrich(calls: DataFrame, prices: DataFrame, tasks: DataFrame | None = None, logged_only: bool = False) -> DataFrame:
    """Calls with cost, family and consumer. `logged_only` ignores recovered output."""
    if logged_only:
        calls = calls.withColumn("output", F.col("output_logged"))
    priced = with_prices(calls, prices).withColumn("cost_p", call_cost())
    if tasks is not None:
        priced = priced.join(tasks.select("source", "task_id", "family"), ["source", "task_id"], "left")
    elif "family" not in priced.columns:
        priced = priced.withColumn("family", F.lit(None).cast("string"))
    reread = F.col("reread") if "reread" in priced.columns else F.lit(False)
    return priced.withColumns({
        "tokens": F.col("input_total") + F.col("output"),
        "recovered": F.col("output") - F.col("output_logged"),
        "category": labels.category(F.col("trigger"), F.col("family"), reread),
    })


def task_stats(calls: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per (source, task_id), over every session the task appears in.

    Input is `enrich` output. All aggregates merge, so a task holding most calls is pre-aggregated map-side.
    """
    main = is_main()
    first_main = F.when(main, pos())
    c = F.col
    stats = calls.groupBy("source", "task_id").agg(
        F.min_by("session_key", pos()).alias("session_key"),
        F.min_by("project", pos()).alias("project"),
        F.bool_and("tracked").alias("tracked"),
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        F.count(F.when(main, 1)).alias("turns_main"),
        F.count(F.when(~main, 1)).alias("turns_sub"),
        F.sum("tokens").alias("tokens"), F.sum("output").alias("output"),
        F.sum("input_total").alias("input_total"),
        F.min_by("input_total", first_main).alias("first_input"),
        F.min_by("cache_read", first_main).alias("first_cache_read"),
        F.min_by("model", first_main).alias("first_model"),
        F.min_by(c("cost_p") - c("output") * c("p_out"), first_main).alias("floor_p"),
        F.min_by(c("input_total") * c("p_read"), first_main).alias("reread_p"),
        F.coalesce(F.sum(F.when(~main, c("tokens"))), F.lit(0)).alias("sub_tokens"),
        F.sum("recovered").alias("recovered"),
        F.coalesce(exact_sum("cost_p"), F.lit(0).cast("decimal(30,0)")).alias("cost_p"),
        F.count(F.when(c("cost_p").isNull(), 1)).alias("unpriced"),
    ).withColumn("turns", c("turns_main") + c("turns_sub"))
    if meta is not None:
        extra = [n for n in ("family", "family_source", "command", "started_us", "prompt_chars") if n in meta.columns]
        stats = stats.join(meta.select("source", "task_id", *extra), ["source", "task_id"], "left")
    started = F.coalesce("started_us", "first_us") if "started_us" in stats.columns else c("first_us")
    return stats.withColumn("started_us", started)


def real_tasks(stats: DataFrame) -> DataFrame:
    """Tasks that can teach something: tied to a prompt and with a main-thread call."""
    return stats.filter(F.col("tracked") & (F.col("turns_main") > 0) & (F.coalesce("first_input", F.lit(0)) > 0))


def task_ranks(stats: DataFrame) -> DataFrame:
    """Position of a task in its session by (start, id), 1 for the first."""
    return scan(stats, ["session_key"], ["started_us", "task_id"], rank=running_sum(F.lit(1).cast("bigint")))


def finished_only(stats: DataFrame, idle_us: int = 3_600_000_000) -> DataFrame:
    """Drop each session's last task when it ended less than an hour before the newest call of all."""
    last = stats.groupBy("session_key").agg(F.max(F.struct("started_us", "task_id")).alias("__last"))
    newest = stats.agg(F.max("last_us").alias("__newest"))  # one row
    return (
        stats.join(last, "session_key").join(F.broadcast(newest))
        .filter(~((F.col("__last.task_id") == F.col("task_id")) & (F.col("__newest") - F.col("last_us") < idle_us)))
        .drop("__last", "__newest")
    )


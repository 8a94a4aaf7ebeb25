"""Views that give the test tables the shape of call logs.

`events` holds no model calls, so each event stands for one call and every figure
follows from it by whole-number arithmetic. The same rules are written in SQL in
`plans/oracle.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from callmeter.functions import labels
from callmeter.operators.ordered import last_seen, running_sum, scan, with_slices
from callmeter.sources.prices import PriceTable

PRICES = PriceTable(models={
    "alpha-5": {"input": "5.00", "output": "25.00", "cache_read": "0.50", "max_output": 128000},
    "alpha-5-5": {"input": "4.00", "output": "20.00", "cache_read": "0.20", "max_output": 128000},
    "beta-4-5": {"input": "1.00", "output": "5.00", "cache_read": "0.10", "max_output": 64000},
})
ORDER = ["t_us", "turn_id"]
START = "2024-01-01 00:00:00"
START_US = 1704067200000000  # the same instant, microseconds since 1970


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event in the shape of the call contract."""
    ev = events(spark, sf_dir)
    rows = ev.count()  # from the file footers
    return calls_from(ev, rows)


def calls_from(ev: DataFrame, rows: int | None = None) -> DataFrame:
    c = F.col
    src = ev.select(
        c("event_id").alias("turn_id"), c("user_id").alias("session_key"), "event_type",
        F.floor(c("value") * 10).cast("bigint").alias("v10"),
        F.expr(f"{START_US} + timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{START}', ts) div 60").alias("t_us"),
    )
    src = with_slices(src, ["session_key"], "t_us", rows)
    main = c("event_type") != "error"
    seq = scan(src, ["session_key"], ORDER,
               task_no=running_sum(F.when(c("event_type") == "signup", 1).otherwise(0).cast("bigint")),
               main_no=running_sum(F.when(main, 1).otherwise(0).cast("bigint")))
    base = seq.select(
        *seq.columns,
        F.when(c("event_type") == "signup", "user_turn").when(~main, "subagent").otherwise("tool_call").alias("trigger"),
        F.when(c("task_no") > 0, c("session_key") * 100000 + c("task_no")).otherwise(F.lit(-1)).cast("bigint").alias("task_id"),
        F.when(~main, "beta-4-5-20251001").when((c("session_key") + c("task_no")) % 7 == 0, "alpha-5")
        .otherwise("alpha-5-5").alias("model"),
        F.when(main, 20000 + 600 * ((c("main_no") - 1) % 40)).otherwise(5000 + 10 * (c("turn_id") % 97)).alias("input_total"),
        F.when(c("session_key") % 3 == 0, 3600).otherwise(300).cast("bigint").alias("ttl"),
    )
    lagged = scan(base, ["session_key"], ORDER,
                  prev=last_seen(F.when(main, F.struct("t_us", "input_total", "model"))))
    lost = (
        (c("t_us") - c("prev.t_us") > c("ttl") * 1000000) | (c("turn_id") % 29 == 0) | (c("model") != c("prev.model"))
    )
    read = (
        F.when(~main | c("prev").isNull(), 0)
        .when(lost, 4000 * (c("session_key") % 2))
        .otherwise(F.least(c("prev.input_total"), c("input_total") - 2))
    ).cast("bigint")
    out = lagged.withColumn("cache_read", read)
    write = c("input_total") - 2 - c("cache_read")
    keep = [n for n in ("slice",) if n in out.columns]
    return out.select(
        "turn_id", "session_key", "t_us", "trigger", "task_id", "model", "input_total", "cache_read",
        F.lit(2).cast("bigint").alias("input_new"),
        write.alias("cache_write"),
        F.when(c("session_key") % 3 == 0, write).otherwise(0).cast("bigint").alias("cache_write_1h"),
        (100 + c("v10")).alias("output"),
        # every second sub-agent call was logged short and recovered from its result
        F.when(~main & (c("turn_id") % 2 == 0), 3).otherwise(100 + c("v10")).cast("bigint").alias("output_logged"),
        (main | (c("turn_id") % 2 == 0)).alias("output_exact"),
        F.lit(None).cast("bigint").alias("reasoning"),
        F.lit(False).alias("after_compaction"),
        (1000 + c("turn_id") % 900).alias("added_chars"),
        (c("task_id") != -1).alias("tracked"),
        F.concat(F.lit("p"), c("session_key") % 12).alias("project"),
        F.concat(F.lit("v"), c("session_key") % 3).alias("version"),
        F.lit("log").alias("source"),
        "event_type", "task_no", *keep,
    )


def main_calls(df: DataFrame) -> DataFrame:
    return df.filter(F.col("trigger") != "subagent")


def call_tools(calls_df: DataFrame) -> DataFrame:
    """One tool use per main call that asks for one."""
    c = F.col
    name = (F.when(c("event_type") == "view", "Read").when(c("event_type") == "click", "Bash")
            .when((c("event_type") == "purchase") & (c("turn_id") % 2 == 0), "Edit")
            .when(c("event_type") == "purchase", "Agent"))
    return main_calls(calls_df).select(
        "source", "session_key", "turn_id", "task_id", "t_us", F.lit(0).alias("ord"), name.alias("name"),
        F.when((c("event_type") == "click") & (c("turn_id") % 3 == 0), "pytest -q --durations=5")
        .when(c("event_type") == "click", "ls").alias("command"),
        *[n for n in ("slice",) if n in calls_df.columns],
    ).filter(c("name").isNotNull())


def file_events(calls_df: DataFrame) -> DataFrame:
    c = F.col
    return calls_df.filter(c("trigger") == "tool_call").select(
        "session_key", "task_id", "t_us", "turn_id", F.lit("main").alias("thread"),
        F.when(c("turn_id") % 37 == 0, ".mcp.json").otherwise(F.concat(F.lit("f"), c("turn_id") % 11)).alias("path"),
        F.when(c("turn_id") % 3 == 0, "read").when(c("turn_id") % 3 == 1, "write").otherwise("search").alias("action"),
        *[n for n in ("slice",) if n in calls_df.columns],
    )


def prices(spark: SparkSession) -> DataFrame:
    return PRICES.frame(spark)


__all__ = ["calls", "calls_from", "main_calls", "call_tools", "file_events", "prices", "labels"]


def lined_calls(calls_df: DataFrame) -> DataFrame:
    """Calls with `line`, their place in the session's log (every call takes two places)."""
    seq = scan(calls_df, ["session_key"], ORDER, n=running_sum(F.lit(1).cast("bigint")),
               main_no=running_sum((F.col("trigger") != "subagent").cast("bigint")))
    return seq.withColumn("line", 2 * F.col("n")).drop("n")


def snapshots(lined: DataFrame) -> DataFrame:
    """A cumulative counter after every 10th main call of a session, to its end, one row per model it names.

    By `session_key % 6` the counter restarts after the 20th main call, jumps once, drifts up,
    drifts down, starts far ahead, or is exact; every 13th session has none.
    """
    c = F.col
    main = c("trigger") != "subagent"
    span = F.when(main, F.ceil(c("main_no") / 10)).otherwise(F.floor(c("main_no") / 10) + 1).cast("bigint")
    had = c("session_key") % 13 != 0
    marks = lined.filter(had & main & (c("main_no") % 10 == 0)).select(
        "session_key", (c("main_no") / 10).cast("bigint").alias("snap"), (c("line") + 1).alias("line"),
        *[n for n in ("slice",) if n in lined.columns])
    keep = [n for n in ("slice",) if n in lined.columns]
    sums = (lined.filter(had).withColumn("span", span).groupBy("session_key", "model", "span")
            .agg(*[F.sum(n).alias(n) for n in ("input_new", "cache_read", "cache_write", "output")]))
    # running sums over the snapshots of a session, one row a snapshot and model that the counter has seen since its start
    since = ((c("session_key") % 6 == 0) & (c("snap") > 2)).alias("since")
    so_far = Window.partitionBy("session_key", "model", "since").orderBy("snap").rowsBetween(Window.unboundedPreceding, 0)
    parts = ("input_new", "cache_read", "cache_write", "output")
    grid = marks.join(sums.select("session_key", "model").distinct(), "session_key").select("*", since)
    counted = (grid.join(sums.withColumnRenamed("span", "snap"), ["session_key", "model", "snap"], "left")
               .select("session_key", "snap", "line", "model", *keep, *[F.sum(n).over(so_far).alias(n) for n in parts])
               .filter("input_new IS NOT NULL"))
    kind = c("session_key") % 6
    drift = (F.when((kind == 1) & (c("snap") >= 3), 50000).when(kind == 2, 3000 * c("snap"))
             .when(kind == 3, -700 * c("snap")).when(kind == 4, 1000000).otherwise(0))
    first = F.min("model").over(Window.partitionBy("session_key", "snap")) == c("model")
    return counted.select(
        "session_key", "line", "model", c("input_new").alias("c_input"),
        (c("cache_read") + F.when(first, drift).otherwise(0)).cast("bigint").alias("c_read"),
        c("cache_write").alias("c_write"), c("output").alias("c_output"), *keep)


# thirty invented prompts; which one opens a task follows from its numbers
PHRASES = (
    "continue", "ok.", "yes", "go ahead!", "thanks",
    "fix the cart total in src/cart.py",
    "refactor the checkout into two modules: shop/checkout.py and shop/totals.py",
    "review the payment module please",
    "measure how slow the import is",
    "Traceback (most recent call last)\n  File main.py line 3\nValueError: bad row",
    "why does the login page redirect twice?",
    "add these:\n- dark mode\n- a logout button\n- keyboard shortcuts",
    "1. rename the table\n2. migrate the rows\n3. drop the old index",
    "what does this function return?",
    "audit the session handling in auth/session.ts",
    "count the rows of data/orders.csv",
    "npm ERR! missing script: build",
    "explain the retry policy",
    "implement the export to report.xlsx and summary.pdf",
    "check the code in lib/util.rs, error[E0308] appears",
    "how many users signed up last week?",
    "rewrite README.md for new people",
    "profile the search endpoint",
    "FAILED tests/test_api.py",
    "write the invoice email text",
    "migrate the invoice ledger schema to partitions",
    "migrate the payment ledger schema to partitions",
    "bench the parser against the old one",
    "move the settings page under account",
    "<command-name>/compact</command-name> keep the plan",
)


def phrase(n):
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (n + 1).cast("int"))


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of `conversations`, each followed by one of the phrases."""
    c = F.col
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(c("role") == "user")
    return rows.select("conv_id", "turn", (c("conv_id") * 1000 + c("turn")).alias("prompt_id"),
                       F.concat(c("text"), F.lit(" "), phrase((c("conv_id") * 7 + c("turn")) % 30)).alias("text"))


def task_prompts(stats: DataFrame) -> DataFrame:
    """The prompt that opened each tracked task of the bridge."""
    c = F.col
    return stats.filter("tracked").select("source", "task_id", phrase((c("task_id") * 7) % 30).alias("text"))


# ------------------------------------------------------------------ log lines


def log_lines(calls_df: DataFrame) -> DataFrame:
    """The calls written as log lines: a prompt or a tool result, then 1 to 4 lines that repeat the usage.

    Only prompts carry a prompt id; everything else finds its task through its parents.
    """
    c = F.col
    main = c("trigger") != "subagent"
    seq = scan(calls_df, ["session_key"], ORDER, before=last_seen(c("turn_id")), asked=last_seen(F.when(main, c("turn_id"))),
               place=running_sum(F.lit(1).cast("bigint")))
    size = lambda i: (1 + i % 4)
    text = lambda x: x.cast("string")
    end = F.when(c("before").isNotNull(), F.concat(F.lit("a"), text(c("before")), F.lit("_"), text(size(c("before")))))
    opener = F.when(c("trigger") == "user_turn", F.concat(F.lit("p"), text(c("turn_id")))).when(
        c("trigger") == "tool_call", F.concat(F.lit("r"), text(c("turn_id"))))
    stamp = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    n = size(c("turn_id"))
    # lines are many times larger than the rows they are made from: spread them first, as file splits would be
    seq = seq.repartition(calls_df.sparkSession.sparkContext.defaultParallelism, "turn_id")
    rows = seq.withColumns({"end": end, "opener": opener, "stamp": stamp, "n": n, "line_no": F.explode(F.sequence(F.lit(0), n))})
    rows = rows.filter((c("line_no") > 0) | c("opener").isNotNull())
    uuid = F.when(c("line_no") == 0, c("opener")).otherwise(F.concat(F.lit("a"), text(c("turn_id")), F.lit("_"), text(c("line_no"))))
    parent = F.when(c("line_no") == 0, c("end")).when(c("line_no") == 1, F.coalesce("opener", "end")).otherwise(
        F.concat(F.lit("a"), text(c("turn_id")), F.lit("_"), text(c("line_no") - 1)))
    head = F.struct(uuid.alias("uuid"), parent.alias("parentUuid"), c("stamp").alias("timestamp"), c("version"),
                    F.concat(F.lit("/srv/"), c("project")).alias("cwd"))
    both = lambda *more: F.to_json(F.struct("head.*", *more))
    prompt = both(F.lit("user").alias("type"), text(c("task_id")).alias("promptId"),
                  F.struct(F.concat(F.lit("go "), text(c("turn_id"))).alias("content")).alias("message"))
    result = both(F.lit("user").alias("type"), F.struct(F.array(F.struct(
        F.lit("tool_result").alias("type"), F.concat(F.lit("t"), text(F.coalesce("asked", F.lit(-1)))).alias("tool_use_id"),
        F.repeat(F.lit("x"), (c("turn_id") % 50).cast("int")).alias("content"))).alias("content")).alias("message"))
    usage = F.struct(c("input_new").alias("input_tokens"), c("cache_read").alias("cache_read_input_tokens"),
                     c("cache_write").alias("cache_creation_input_tokens"),
                     F.when(c("line_no") == c("n"), c("output")).otherwise(F.expr("output div 2")).alias("output_tokens"))
    block = F.array(F.struct(F.when(c("line_no") == c("n"), "tool_use").otherwise("thinking").alias("type"),
                             F.concat(F.lit("t"), text(c("turn_id"))).alias("id"), F.lit("Read").alias("name")))
    reply = both(F.lit("assistant").alias("type"), (~main).alias("isSidechain"), F.lit("s").alias("agentId"), F.struct(
        F.concat(F.lit("m"), text(c("turn_id"))).alias("id"), "model", usage.alias("usage"), block.alias("content")).alias("message"))
    value = F.when((c("line_no") == 0) & (c("trigger") == "user_turn"), prompt).when(c("line_no") == 0, result).otherwise(reply)
    rows = rows.withColumn("head", head)
    return _as_lines(rows, value, c("place") * 10 + c("line_no"))


def _as_lines(rows: DataFrame, value, place) -> DataFrame:
    key = F.col("session_key").cast("string")
    return rows.select(key.alias("session_key"), key.alias("session_id"), F.lit("logs").alias("project_dir"),
                       F.lit(None).cast("string").alias("agent_file"), key.alias("file"), value.alias("value"),
                       F.struct(F.lit(0).alias("sub"), key.alias("file"), F.lit(0).cast("bigint").alias("block"),
                                place.cast("bigint").alias("row")).alias("pos"), F.lit(False).alias("unterminated"))


def damaged_lines(ev: DataFrame) -> DataFrame:
    """`events.props` as log lines, many of them damaged or of another type."""
    c = F.col
    i = c("event_id")
    value = (F.when(i % 17 == 0, F.substring("props", 1, 4)).when(i % 19 == 0, F.concat(F.lit("["), c("props"), F.lit("]")))
             .when(i % 13 == 0, F.lit('{"type": "summary"}')).when(i % 11 == 0, F.lit('{"type": "hologram", "usage": {"n": 1}}'))
             .when(i % 7 == 0, F.lit('{"type": "assistant", "message": {"id": "a", "usage": {"input_tokens": "12", "output_tokens": 1}}}'))
             .when(i % 5 == 0, F.lit('{"type": "user", "message": {"content": "hello"}}')).otherwise(c("props")))
    return _as_lines(ev.withColumn("session_key", c("user_id")), value, i)


# ------------------------------------------------------------------ prompts and estimates


def asked(real: DataFrame) -> DataFrame:
    """A prompt one second before each real task, some with a model or a family given."""
    c = F.col
    family = F.element_at(F.array(*[F.lit(f) for f in labels.FAMILIES]), (c("task_id") % 4 + 1).cast("int"))
    return real.select(
        c("task_id").alias("prompt_id"), "session_key", (c("started_us") - 1_000_000).alias("made_us"),
        F.length(phrase((c("task_id") * 7) % 30)).cast("bigint").alias("chars"), (c("task_id") % 3 * 1000).alias("add_chars"),
        F.when(c("task_id") % 7 == 0, "alpha-5").alias("model"), F.when(c("task_id") % 5 == 0, family).alias("family"))


def estimates(real: DataFrame) -> DataFrame:
    """Recorded estimates: one or two before most tasks, some far too early."""
    c = F.col
    early = F.when(c("task_id") % 7 == 0, 2000).otherwise(c("task_id") % 40)
    rows = real.filter(c("task_id") % 4 != 0).withColumn("second", F.explode(F.array(F.lit(0), F.lit(1)))).filter(
        (c("second") == 0) | (c("task_id") % 5 == 0))
    est = c("task_id") * 2 + c("second")
    rows = rows.select(est.alias("est_id"), "session_key", (c("started_us") - (early + 2 * c("second")) * 1_000_000).alias("made_us"))
    e = c("est_id")
    return rows.withColumns({
        "lo": 1 + e % 3, "p50": F.when(e % 23 != 0, 3 + e % 3), "hi": 7 + e % 3, "spread": e % 29 == 0,
        "cost_lo": 0.01 * (e % 3), "cost_p50": 0.05 + 0.01 * (e % 3), "cost_hi": 0.2 + 0.01 * (e % 3),
        "input_next": 20000 + 600 * (e % 50), "cached": F.when(e % 2 == 0, 20000).otherwise(0).cast("bigint"),
        "family": F.when(e % 2 == 0, "question").otherwise("refactor"), "family_source": F.when(e % 9 == 0, "declared").otherwise("guessed")})

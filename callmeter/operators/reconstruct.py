"""From log lines to calls, tasks, tool uses, file events, counters and line outcomes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from callmeter.functions.labels import project_name
from callmeter.functions.text import command_of
from callmeter.operators.chains import launched_tasks, nearest_prompt, trigger_walk
from callmeter.operators.reports import top_per_group
from callmeter.operators.tasks import READ_TOOLS, SEARCH_TOOLS, WRITE_TOOLS, guess_family
from callmeter.session import cut, dealt

c = F.col
KEY = ["session_key"]
# fixed values: record types that carry no usage
IGNORED_TYPES = ("attachment", "system", "queue-operation", "last-prompt", "mode", "cost-state", "atis-latch", "summary",
                 "file-history-snapshot", "custom-title", "progress")
# fixed values: keys that say a record holds token counts
TOKEN_KEYS = ("usage", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
              "inputTokens", "outputTokens", "modelUsage")
USAGE = {"input_new": "input_tokens", "cache_read": "cache_read_input_tokens",
         "cache_write": "cache_creation_input_tokens", "output": "output_tokens"}
COUNTERS = {"c_input": "inputTokens", "c_read": "cacheReadInputTokens", "c_write": "cacheCreationInputTokens",
            "c_output": "outputTokens"}
SYNTHETIC = "<synthetic>"


def _kind(path: str, v: str = "v") -> str:
    return f"schema_of_variant(variant_get({v}, '{path}', 'variant'))"


def _str(path: str, v: str = "v") -> Column:
    """The string at a path; null when it is missing or anything but a string."""
    return F.expr(f"CASE WHEN {_kind(path, v)} = 'STRING' THEN variant_get({v}, '{path}', 'string') END")


def _int(path: str, v: str = "v") -> Column:
    """A whole number of 0 or more; text such as "12", booleans and fractions do not count."""
    return F.expr(f"CASE WHEN {_kind(path, v)} = 'BIGINT' AND variant_get({v}, '{path}', 'bigint') >= 0 "
                  f"THEN variant_get({v}, '{path}', 'bigint') END")


def _true(path: str) -> Column:
    return F.coalesce(F.expr(f"try_variant_get(v, '{path}', 'boolean')"), F.lit(False))


def _is_object(path: str) -> Column:
    return F.coalesce(F.expr(f"{_kind(path)} LIKE 'OBJECT%'"), F.lit(False))


def _blocks(content: str) -> str:
    return f"try_cast({content} AS ARRAY<VARIANT>)"


def lies_deeper(content: str, depth: int) -> str:
    """SQL for whether message content holds a list more than `depth` lists down."""
    is_list = f"coalesce(schema_of_variant({content}) LIKE 'ARRAY%', false)"
    if depth == 0:
        return is_list
    b = f"b{depth}"
    return f"({is_list} AND coalesce(exists({_blocks(content)}, {b} -> {lies_deeper(f"try_variant_get({b}, '$.content', 'variant')", depth - 1)}), false))"


def content_depth(parsed: DataFrame, depth: int = 4) -> int:
    """How many lists down the text of any line lies, or a little more. Each list has its bracket, so lines with few aren't looked into."""
    content, result = "try_variant_get(v, '$.message.content', 'variant')", "try_variant_get(r, '$.content', 'variant')"
    while True:
        some = parsed.filter(F.char_length("value") - F.char_length(F.replace("value", F.lit("["))) > depth)
        deeper = F.expr(f"{lies_deeper(content, depth)} OR coalesce(exists(results, r -> {lies_deeper(result, depth)}), false)")
        if some.filter(deeper).isEmpty():
            return depth
        depth *= 2


def text_length(content: str, depth: int) -> str:
    """SQL for the characters in message content: a string, or a list of strings, text blocks and nested content, `depth` lists down."""
    own = f"CASE WHEN schema_of_variant({content}) = 'STRING' THEN length(CAST({content} AS STRING)) ELSE 0 END"
    if depth == 0:
        return own
    b = f"b{depth}"
    text, nested = f"variant_get({b}, '$.text', 'variant')", f"variant_get({b}, '$.content', 'variant')"
    block = (f"CASE WHEN schema_of_variant({b}) = 'STRING' THEN length(CAST({b} AS STRING)) "
             f"WHEN schema_of_variant({text}) = 'STRING' THEN length(CAST({text} AS STRING)) "
             f"WHEN {nested} IS NOT NULL THEN {text_length(nested, depth - 1)} ELSE 0 END")
    items = _blocks(content)
    return (f"CASE WHEN schema_of_variant({content}) LIKE 'ARRAY%' "
            f"THEN coalesce(aggregate({items}, 0, (a{depth}, {b}) -> a{depth} + {block}), 0) ELSE {own} END")


def parse(lines: DataFrame) -> DataFrame:
    """Lines with typed columns and the route each one takes: (bucket, reason, kind)."""
    # generated, not projected: later filters stop here and do not parse the line once more per condition
    v = lines.withColumn("v", F.explode(F.array(F.expr("try_parse_json(make_valid_utf8(value))"))))
    is_object = F.ltrim("value").startswith("{")
    blocks = F.expr("try_variant_get(v, '$.message.content', 'array<variant>')")
    typed = v.withColumns({
        "type": _str("$.type"), "line_version": _str("$.version"), "cwd": _str("$.cwd"), "uuid": _str("$.uuid"),
        "parent": _str("$.parentUuid"), "prompt_id": _str("$.promptId"), "stamp": _str("$.timestamp"),
        "subtype": F.expr("try_variant_get(v, '$.subtype', 'string')"),
        "blocks": blocks,
        "thread": F.coalesce("agent_file", F.when(_true("$.isSidechain"), F.coalesce(_str("$.agentId"), F.lit("sidechain"))),
                             F.lit("main")),
    })
    typed = typed.withColumn("t_us", F.unix_micros(F.try_to_timestamp("stamp")))
    results = F.filter("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result")
    typed = typed.withColumns({
        "has_message": c("type").isin("user", "assistant") & _is_object("$.message"),
        "results": F.when(c("type") == "user", results),
        "content_kind": F.expr(_kind("$.message.content")),
        "model": F.coalesce(_str("$.message.model"), F.lit("unknown")),
        "key": F.coalesce(_str("$.message.id"), _str("$.requestId"), c("uuid")),
        **{n: _int(f"$.message.usage.{f}") for n, f in USAGE.items()},
    })
    missing = [F.expr(f"variant_get(v, '$.message.usage.{f}', 'variant') IS NULL") for f in USAGE.values()]
    fields_ok = F.lit(True)
    for absent, n in zip(missing, USAGE):
        fields_ok = fields_ok & (absent | c(n).isNotNull())
    usage_ok = fields_ok & c("input_new").isNotNull() & c("output").isNotNull()
    has_results = F.coalesce(F.size("results") > 0, F.lit(False))
    readable = F.coalesce((c("content_kind") == "STRING") | c("content_kind").startswith("ARRAY"), F.lit(False))
    user, assistant = c("type") == "user", c("type") == "assistant"
    route = lambda bucket, reason, kind=None: F.struct(
        F.lit(bucket).alias("bucket"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        F.lit(kind).cast("string").alias("kind"))
    routed = (
        F.when(c("v").isNull() & c("unterminated"), route("unreadable", "truncated_last_line"))
        .when(c("v").isNull(), route("unreadable", "bad_json"))
        .when(~is_object, route("unreadable", "not_an_object"))
        .when(c("type").isNull(), route("unreadable", "no_type"))
        .when(user & ~c("has_message"), route("unreadable", "user_without_message"))
        .when(user & has_results, route("used", "user", "tool_result"))
        .when(user & ~readable, route("unreadable", "user_unexpected_content"))
        .when(user & (_true("$.isMeta") | _true("$.isCompactSummary")), route("used", "user", "meta"))
        .when(user, route("used", "user", "prompt"))
        .when(assistant & ~c("has_message"), route("unreadable", "assistant_without_message"))
        .when(assistant & (c("model") == SYNTHETIC), route("ignored", "synthetic_message", "other"))
        .when(assistant & ~usage_ok, route("unreadable", "assistant_bad_usage", "other"))
        .when(assistant & c("key").isNull(), route("unreadable", "assistant_without_id"))
        .when(assistant, route("used", "assistant", "assistant"))
        .when(c("type").isin(*IGNORED_TYPES), route("ignored", c("type"), "other"))
        .otherwise(route("unknown_type", c("type"), "other"))
    )
    tokens = c("value").rlike('"(' + "|".join(TOKEN_KEYS) + r')"\s*:')
    return typed.withColumn("__r", routed).select("*", "__r.*").drop("__r").withColumn(
        "has_tokens", (c("bucket") == "unknown_type") & tokens)


def line_outcomes(parsed: DataFrame, keys: tuple[str, ...] = ("session_key",)) -> DataFrame:
    """Counts by bucket and reason; unknown records that carry token fields are counted once more."""
    cells = F.array(F.struct("bucket", "reason"),
                    F.struct(F.when(c("has_tokens"), "unknown_with_tokens").alias("bucket"), c("reason").alias("reason")))
    return (parsed.select(*keys, F.explode(cells).alias("o")).filter(c("o.bucket").isNotNull())
            .groupBy(*keys, c("o.bucket").alias("bucket"), c("o.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n")))


def dedup_calls(parsed: DataFrame) -> DataFrame:
    """One row per model call from lines that repeat its usage.

    Identity comes from the first line; usage from the line with the largest output (the later one on
    ties); stop reason from the last line that has one. All of it merges map-side.
    """
    rows = parsed.filter(c("kind") == "assistant")
    usage = F.struct(*[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in USAGE],
                     F.coalesce(_int("$.message.usage.cache_creation.ephemeral_1h_input_tokens"), F.lit(0).cast("bigint")).alias("w1h"),
                     _int("$.message.usage.output_tokens_details.thinking_tokens").alias("reasoning"))
    stop = _str("$.message.stop_reason")
    first = F.struct("uuid", "parent", "t_us", "model", "thread", "agent_file")
    # the record itself stays behind: only these columns are sorted and shuffled
    narrow = rows.select(*KEY, "key", "pos", "session_id", "t_us", "output", first.alias("first"), usage.alias("usage"), stop.alias("stop"))
    return narrow.groupBy(*KEY, "key").agg(
        F.min("pos").alias("pos"), F.min_by("first", "pos").alias("first"),
        F.max_by("usage", F.struct("output", "pos")).alias("usage"),
        F.max_by("stop", F.when(c("stop") != "", c("pos"))).alias("stop_reason"),
        F.max_by("t_us", "pos").alias("last_us"), F.count(F.lit(1)).alias("lines"),
        F.min("session_id").alias("session_id"))


def tool_uses(parsed: DataFrame) -> DataFrame:
    """One row per tool use block of the calls, in order of (pos, ord)."""
    rows = parsed.filter(c("kind") == "assistant").select(*KEY, "key", "thread", "t_us", "pos", F.posexplode("blocks").alias("ord", "b"))
    at = lambda p: _str(p, "b")
    return rows.filter((F.try_variant_get("b", "$.type", "string") == "tool_use")).select(
        *KEY, "key", "thread", "t_us", "pos", "ord", at("$.id").alias("id"), F.coalesce(at("$.name"), F.lit("?")).alias("name"),
        F.coalesce(at("$.input.file_path"), at("$.input.notebook_path")).alias("file_path"), at("$.input.path").alias("path"),
        F.expr("CAST(variant_get(b, '$.input.command', 'variant') AS STRING)").alias("command")).filter(c("id").isNotNull())


def line_nodes(parsed: DataFrame, depth: int | None = None) -> DataFrame:
    """The parent graph: one node per line uuid (the last line wins)."""
    depth = depth or content_depth(parsed)
    result_ids = F.filter(F.transform("results", lambda b: F.try_variant_get(b, "$.tool_use_id", "string")), lambda x: x.isNotNull())
    content = "variant_get(v, '$.message.content', 'variant')"
    results = text_length("variant_get(r, '$.content', 'variant')", depth)
    chars = (F.when(c("kind") == "tool_result", F.expr(f"aggregate(results, 0, (t, r) -> t + {results})"))
             .when(c("kind").isin("prompt", "meta"), F.expr(text_length(content, depth))).otherwise(0))
    boundary = (c("type") == "system") & F.coalesce(c("subtype").contains("compact"), F.lit(False))
    node = F.struct("parent", "prompt_id", "t_us", "kind", chars.cast("bigint").alias("chars"),
                    F.when(c("kind") == "assistant", c("key")).alias("call"),
                    F.coalesce(result_ids, F.array().cast("array<string>")).alias("result_ids"), boundary.alias("boundary"))
    rows = parsed.filter(c("kind").isNotNull() & c("uuid").isNotNull()).select(*KEY, "uuid", "pos", node.alias("node"))
    return rows.groupBy(*KEY, "uuid").agg(F.max_by("node", "pos").alias("node")).select(*KEY, "uuid", "node.*")


def final_usage(parsed: DataFrame) -> DataFrame:
    """Usage a sub-agent's result reports for its last call: (session_key, tool_use_id, ...)."""
    u = "$.toolUseResult.usage"
    agent = F.expr("CAST(variant_get(v, '$.toolUseResult.agentId', 'variant') AS STRING)")
    rows = parsed.filter((c("kind") == "tool_result") & _is_object(u) & F.coalesce(agent != "", F.lit(False))).select(
        *KEY, "pos", F.explode(F.transform("results", lambda b: F.try_variant_get(b, "$.tool_use_id", "string"))).alias("tool_use_id"),
        F.struct(*[F.coalesce(_int(f"{u}.{f}"), F.lit(0).cast("bigint")).alias(n) for n, f in USAGE.items()],
                 F.coalesce(_int(f"{u}.cache_creation.ephemeral_1h_input_tokens"), F.lit(0).cast("bigint")).alias("w1h"),
                 _int(f"{u}.output_tokens_details.thinking_tokens").alias("reasoning")).alias("final"))
    return rows.filter(c("tool_use_id").isNotNull()).groupBy(*KEY, "tool_use_id").agg(F.max_by("final", "pos").alias("final"))


def snapshots(parsed: DataFrame) -> DataFrame:
    """Counter snapshots of main files: one row per (place, model) with the last timestamp seen before it."""
    rows = parsed.filter((c("type") == "cost-state") & c("agent_file").isNull() & _is_object("$.modelUsage")).select(
        *KEY, _line(c("pos")).alias("line"), F.explode(F.expr("try_variant_get(v, '$.modelUsage', 'map<string,variant>')")).alias("model", "u"))
    return rows.filter(F.expr("schema_of_variant(u) LIKE 'OBJECT%'")).select(
        *KEY, "line", "model", *[F.coalesce(_int(f"$.{f}", "u"), F.lit(0).cast("bigint")).alias(n) for n, f in COUNTERS.items()])


def raw_counter(parsed: DataFrame) -> DataFrame:
    """Snapshots with the time of the line before them."""
    from callmeter.operators.ordered import last_seen, scan

    timed = scan(parsed.filter(c("agent_file").isNull() & c("v").isNotNull()).select(*KEY, "pos", "stamp"), KEY, ["pos"],
                 after=last_seen(c("stamp"), inclusive=True))
    return snapshots(parsed).join(timed.select(*KEY, _line(c("pos")).alias("line"), "after"), [*KEY, "line"])


def _line(pos: Column) -> Column:
    return F.struct(pos["block"].alias("block"), pos["row"].alias("row"))


def file_events(uses: DataFrame, call_tasks: DataFrame) -> DataFrame:
    action = (F.when(c("name").isin(*READ_TOOLS) & c("file_path").isNotNull(), "read")
              .when(c("name").isin(*WRITE_TOOLS) & c("file_path").isNotNull(), "write")
              .when(c("name").isin(*SEARCH_TOOLS) & c("path").isNotNull(), "search"))
    rows = uses.withColumn("action", action).filter(c("action").isNotNull())
    return rows.join(call_tasks, [*KEY, "key"], "left").select(
        *KEY, "task_id", "t_us", c("key").alias("turn_id"), "thread", "pos", "ord", "id",
        F.when(c("action") == "search", c("path")).otherwise(c("file_path")).alias("path"), "action")


def reread_uses(events: DataFrame) -> DataFrame:
    """Ids of reads of a path the same thread had read before."""
    at = F.struct("pos", "ord")
    reads = events.filter(c("action") == "read")
    first = reads.groupBy(*KEY, "thread", "path").agg(F.min(at).alias("__first"))
    return reads.join(first, [*KEY, "thread", "path"]).filter(at > c("__first")).select(*KEY, "id").distinct()


@dataclass
class Tables:
    calls: DataFrame
    tasks: DataFrame
    tools: DataFrame
    files: DataFrame
    snapshots: DataFrame
    outcomes: DataFrame
    sessions: DataFrame

    def owned(self) -> "Tables":
        """Calls and tasks with one owner each: a resumed session repeats its parent's history."""
        return replace(self, calls=first_owner(self.calls, ["source", "turn_id"]), tasks=first_owner(self.tasks, ["source", "task_id"]))


def reconstruct(lines: DataFrame, sidecars: DataFrame | None = None, source: str = "log") -> Tables:
    parsed = parse(lines)
    calls = cut(dedup_calls(parsed))
    uses = cut(tool_uses(parsed))
    depth = content_depth(parsed)
    nodes = cut(line_nodes(parsed, depth))
    spark = lines.sparkSession
    if sidecars is None:
        sidecars = spark.createDataFrame([], "session_key string, agent_id string, tool_use_id string, bad boolean")
    launches = sidecars.filter(c("tool_use_id").isNotNull()).select(*KEY, c("agent_id").alias("thread"), "tool_use_id")
    by_id = uses.groupBy(*KEY, "id").agg(F.max_by(F.struct("key", "name"), F.struct("pos", "ord")).alias("u"))
    # thread -> the call that launched it
    launcher = launches.join(by_id, (launches["session_key"] == by_id["session_key"]) & (c("tool_use_id") == c("id"))).select(
        launches["session_key"], "thread", c("u.key").alias("launch_key"))

    # -- tasks of calls: up the chain, else the launcher's task (a launcher may itself be launched)
    roots = nearest_prompt(nodes)
    first = calls.select(*KEY, "key", "session_id", c("first.uuid").alias("uuid"), c("first.thread").alias("thread"))
    call_tasks = first.join(dealt(roots), [*KEY, "uuid"], "left").select(*KEY, "key", "thread", "session_id", c("root_prompt").alias("task_id"))
    call_tasks = launched_tasks(call_tasks, launcher)
    call_tasks = cut(call_tasks.withColumn("task_id", F.coalesce("task_id", F.concat("session_id", F.lit(":untracked"))))
                     .select(*KEY, "key", "task_id"))

    files = file_events(uses, call_tasks)
    walk, hits = trigger_walk(calls.select(*KEY, "key", c("first.parent").alias("parent")), nodes)
    known = by_id.select(*KEY, c("id").alias("tool_use_id"), F.lit(True).alias("__known"))
    again = reread_uses(files).select(*KEY, c("id").alias("tool_use_id"), F.lit(True).alias("__again"))
    rereads = (hits.join(known, [*KEY, "tool_use_id"], "left").join(again, [*KEY, "tool_use_id"], "left")
               .groupBy(*KEY, "key").agg(F.bool_and(F.coalesce("__again", F.lit(False))).alias("reread")))

    # -- output of an agent's last call, from the result its parent received
    last = calls.filter(c("first.thread") != "main").groupBy(*KEY, c("first.thread").alias("thread")).agg(
        F.max_by("key", "pos").alias("key"))
    final = last.join(launches, [*KEY, "thread"]).join(final_usage(parsed), [*KEY, "tool_use_id"]).select(*KEY, "key", "final")

    cwd = parsed.groupBy(*KEY).agg(
        F.min_by("cwd", F.when(c("cwd").isNotNull(), c("pos"))).alias("cwd"), F.min("project_dir").alias("project_dir"),
        F.max_by("line_version", F.when(c("line_version").isNotNull(), c("pos"))).alias("version"),
        F.countDistinct("line_version").alias("versions"), F.min("session_id").alias("session_id"),
        F.count(F.lit(1)).alias("lines"))
    sessions = cwd.withColumn("project", F.coalesce(project_name(c("cwd")), "project_dir"))

    own = calls.join(call_tasks, [*KEY, "key"]).join(walk, [*KEY, "key"]).join(rereads, [*KEY, "key"], "left") \
        .join(final, [*KEY, "key"], "left").join(sessions.select(*KEY, "project", "version"), KEY)
    lines_of = calls.filter(c("first.agent_file").isNull()).select(*KEY, c("key").alias("launch_key"), _line(c("pos")).alias("__line"))
    launch_lines = launcher.join(lines_of, [*KEY, "launch_key"]).select(*KEY, "thread", c("__line").alias("launch_line"))
    own = own.withColumn("thread", c("first.thread")).join(launch_lines, [*KEY, "thread"], "left")
    is_sub = c("thread") != "main"
    same = c("final").isNotNull()
    for n in ("input_new", "cache_read", "cache_write"):
        same = same & (c(f"usage.{n}") == c(f"final.{n}"))
    use = F.when(same, c("final")).otherwise(c("usage"))
    trigger = F.when(is_sub, "subagent").when(c("outcome") == "prompt", "user_turn").when(c("has_ids"), "tool_call").otherwise("user_turn")
    by_walk = (c("outcome") == "prompt") | c("has_ids")
    elapsed = c("last_us") - c("trigger_us")
    recovered = F.coalesce(same, F.lit(False))
    out = own.withColumn("use", use).select(
        F.lit(source).alias("source"), c("key").alias("turn_id"), *KEY, "session_id", "project", "version", c("first.t_us").alias("t_us"),
        c("first.model").alias("model"),
        (c("use.input_new") + c("use.cache_read") + c("use.cache_write")).alias("input_total"),
        c("use.cache_read").alias("cache_read"), c("use.cache_write").alias("cache_write"),
        F.least("use.w1h", "use.cache_write").alias("cache_write_1h"), c("use.input_new").alias("input_new"),
        c("use.output").alias("output"), c("usage.output").alias("output_logged"),
        F.when(recovered, "subagent_result").otherwise("logged").alias("output_source"), c("use.reasoning").alias("reasoning"),
        (~is_sub | recovered | c("stop_reason").isNotNull()).alias("output_exact"),
        "task_id", (~c("task_id").endswith(":untracked")).alias("tracked"), trigger.alias("trigger"),
        F.when(c("trigger_us").isNotNull() & (elapsed >= 0) & by_walk, F.floor(elapsed / 1000)).cast("bigint").alias("duration_ms"),
        F.when(is_sub, c("thread")).alias("agent_id"),
        F.when(by_walk, c("chars")).otherwise(0).alias("added_chars"), F.coalesce("reread", F.lit(False)).alias("reread"),
        "after_compaction", "lines", "pos",
        F.when(c("first.agent_file").isNull(), _line(c("pos"))).otherwise(c("launch_line")).alias("line"))
    out = cut(out)

    # -- tasks: opened by a prompt of the main thread, or by a call that has none
    text = "variant_get(v, '$.message.content', 'variant')"
    said = F.when(c("content_kind") == "STRING", F.expr(f"CAST({text} AS STRING)")).otherwise(
        F.array_join(F.transform("blocks", lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), " "))
    opened = (parsed.filter((c("kind") == "prompt") & (c("thread") == "main"))
              .select(*KEY, F.coalesce("prompt_id", "uuid", F.lit("")).alias("task_id"), "pos", "t_us", command_of(said).alias("command"),
                      F.expr(text_length(text, depth)).cast("bigint").alias("chars"))
              .groupBy(*KEY, "task_id").agg(F.min_by("t_us", "pos").alias("p_us"), F.min_by("command", "pos").alias("command"),
                                            F.sum("chars").alias("prompt_chars")))
    seen = out.groupBy(*KEY, "task_id").agg(F.min_by("t_us", "pos").alias("c_us"))
    tasks = (opened.join(seen, [*KEY, "task_id"], "full_outer").join(sessions.select(*KEY, "project", "cwd"), KEY)
             .select(F.lit(source).alias("source"), *KEY, "task_id", F.coalesce("p_us", "c_us").alias("started_us"), "project", "cwd",
                     "command", F.coalesce("prompt_chars", F.lit(0)).alias("prompt_chars")))
    tools = (uses.join(call_tasks, [*KEY, "key"]).select(
        F.lit(source).alias("source"), *KEY, "task_id", c("key").alias("turn_id"), "thread", "t_us", "pos", "ord", "id", "name", "command"))
    main_tools = tools.filter(c("thread") == "main")
    tasks = guess_family(tasks, main_tools)
    return Tables(out, tasks, tools, files, snapshots(parsed), line_outcomes(parsed), sessions)


def first_owner(rows: DataFrame, key: list[str]) -> DataFrame:
    """One owner per key over all sessions: the first session in (project, session) order keeps the row.

    The project is compared by itself: in a joined key `shop-web/..` would come before `shop/..`.
    """
    project = F.regexp_extract(c("session_key").cast("string"), "^(.*)/[^/]*$", 1)
    return top_per_group(rows, key, [project, c("session_key")], 1, "__rank").drop("__rank")


def contract_violations(calls: DataFrame) -> DataFrame:
    """Calls that break the record contract, with the rule they break."""
    parts = c("cache_read") + c("cache_write") + c("input_new")
    rule = (F.when(~c("trigger").isin("user_turn", "tool_call", "subagent"), "trigger").when(parts != c("input_total"), "input parts")
            .when(c("cache_write_1h") > c("cache_write"), "1h write"))
    return calls.withColumn("rule", rule).filter(c("rule").isNotNull()).select("source", "turn_id", "rule")


def opening_prompts(parsed: DataFrame) -> DataFrame:
    """Text of the first prompt line of each prompt id (main files)."""
    cheap = parsed.filter(c("value").contains('"promptId"'))
    text = "variant_get(v, '$.message.content', 'variant')"
    said = F.when(c("content_kind") == "STRING", F.expr(f"CAST({text} AS STRING)")).otherwise(
        F.array_join(F.transform("blocks", lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), " "))
    rows = cheap.filter((c("kind") == "prompt") & c("agent_file").isNull() & c("prompt_id").isNotNull())
    return rows.groupBy("prompt_id").agg(F.min_by(said, F.struct("session_key", "pos")).alias("text"))


def duplication_audit(parsed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Naive sums over every line against one line per call, and the ratio of each field.

    The line kept here is the last one of the call, as an independent check of `dedup_calls`.
    """
    rows = parsed.filter(c("kind") == "assistant").select(*KEY, "key", "pos", "model", *USAGE)
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    naive = rows.agg(F.count(F.lit(1)).alias("lines"), *[F.sum(zero(n)).alias(f"naive_{n}") for n in USAGE])
    kept = rows.groupBy(*KEY, "key").agg(F.max_by(F.struct(*USAGE), c("pos")).alias("u"))
    once = kept.agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(c(f"u.{n}"), F.lit(0))).alias(f"once_{n}") for n in USAGE])
    both = once.withColumns({n: naive.select(n).scalar() for n in ("lines", *[f"naive_{x}" for x in USAGE])})
    return both.withColumns({
        **{f"ratio_{n}": F.when(c(f"once_{n}") != 0, F.round(c(f"naive_{n}") / c(f"once_{n}"), 4)).otherwise(0.0) for n in USAGE},
        "lines_per_call": F.round(c("lines") / c("calls"), 4)})


def lines_per_call(parsed: DataFrame) -> DataFrame:
    calls = parsed.filter(c("kind") == "assistant").groupBy(*KEY, "key").agg(F.count(F.lit(1)).alias("lines"))
    return calls.groupBy("lines").agg(F.count(F.lit(1)).alias("calls"))

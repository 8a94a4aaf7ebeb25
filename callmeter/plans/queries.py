"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from callmeter.functions import text
from callmeter.functions.money import dollars, exact_sum
from callmeter.operators import (
    backtest, cache, chains, contrast, files, forecast, live, neighbours, reconcile, reconstruct, reports, scores, settle, signs, tasks,
    textscan, tree)
from callmeter.operators.ordered import SLICE, running_sum, scan, with_slices
from callmeter.plans import bridge
from callmeter.session import cut, dealt, scratch_path
from callmeter.streaming import corrections, live as streams, sessions

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Views:
    """The bridged tables of one data folder; each is a lazy plan, built once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return bridge.events(self.spark, self.sf_dir)

    @cached_property
    def rows(self) -> int:
        return self.events.count()  # from the file footers

    @cached_property
    def calls(self) -> DataFrame:
        calls = bridge.calls_from(self.events, self.rows)
        # calls are a stored table in practice; with hot sessions every operator reads it more than once
        return cut(calls) if SLICE in calls.columns else calls

    @cached_property
    def main(self) -> DataFrame:
        return tasks.main_calls(self.calls)

    prices = bridge.PRICES

    @cached_property
    def tools(self) -> DataFrame:
        return bridge.call_tools(self.calls)

    @cached_property
    def files(self) -> DataFrame:
        return bridge.file_events(self.calls)

    @cached_property
    def families(self) -> DataFrame:
        return tasks.guess_family(self.calls.select("source", "task_id").distinct(), self.tools)

    @cached_property
    def enriched(self) -> DataFrame:
        reread = files.reread_calls(self.files).select("turn_id", F.lit(True).alias("reread"))
        flagged = self.calls.join(reread, "turn_id", "left").withColumn("reread", F.coalesce("reread", F.lit(False)))
        return tasks.enrich(flagged, self.prices, self.families)

    @cached_property
    def priced(self) -> DataFrame:
        """Calls with cost, where neither family nor consumer is asked for."""
        return tasks.enrich(self.calls, self.prices)

    @cached_property
    def stats(self) -> DataFrame:
        return with_slices(tasks.task_stats(self.priced, self.families), ["session_key"], "started_us", self.rows)

    @cached_property
    def plain_stats(self) -> DataFrame:
        """Task statistics without families."""
        return with_slices(tasks.task_stats(self.priced), ["session_key"], "started_us", self.rows)

    @cached_property
    def real(self) -> DataFrame:
        return tasks.real_tasks(self.stats)

    @cached_property
    def plain_real(self) -> DataFrame:
        return tasks.real_tasks(self.plain_stats)

    @cached_property
    def pairs(self) -> DataFrame:
        return cache.call_pairs(self.priced)

    @cached_property
    def written_pairs(self) -> DataFrame:
        return cache.call_pairs(self.priced, cache.prefix_file_writes(self.files), 2 * self.rows)

    @cached_property
    def spread_calls(self) -> DataFrame:
        """Forty models instead of three, so that some expiries have no other session beside them."""
        return self.calls.withColumn("model", F.concat(F.lit("m"), c("session_key") % 40))

    @cached_property
    def survivors(self) -> DataFrame:
        cases = cache.expiries(cache.call_pairs(self.spread_calls))
        return cache.other_session_active(self.spread_calls, cases, self.rows)

    @cached_property
    def lined(self) -> DataFrame:
        return cut(bridge.lined_calls(self.calls))  # a stored table in practice, read by every comparison

    @cached_property
    def snapshots(self) -> DataFrame:
        return cut(bridge.snapshots(self.lined))

    @cached_property
    def series(self) -> DataFrame:
        return reconcile.series(self.lined, self.snapshots)

    @cached_property
    def checks(self) -> DataFrame:
        return reconcile.counter_checks(self.lined, self.snapshots)

    @cached_property
    def verdicts(self) -> DataFrame:
        return reconcile.session_status(self.lined, self.snapshots)

    @cached_property
    def prompted(self) -> DataFrame:
        """Real tasks with the features of the prompt that opened them."""
        prompts = bridge.task_prompts(self.plain_stats)
        featured = prompts.select("source", "task_id", *[x.alias(n) for n, x in text.features(c("text")).items()])
        return self.plain_real.join(featured, ["source", "task_id"], "left")

    @cached_property
    def parsed(self) -> DataFrame:
        return reconstruct.parse(bridge.log_lines(self.calls))

    @cached_property
    def asked(self) -> DataFrame:
        return forecast.next_input(bridge.asked(self.plain_real), self.calls, self.prices, rows=2 * self.rows)

    @cached_property
    def chosen(self) -> DataFrame:
        asked = cut(self.asked)
        said = bridge.task_prompts(self.plain_real).join(self.plain_real.select("source", "task_id", "started_us"), ["source", "task_id"])
        return forecast.choose_basis(asked, self.real, forecast.nearest_tasks(asked, said.select("task_id", "started_us", "text")), rows=self.rows)

    @cached_property
    def settled(self) -> DataFrame:
        return settle.settle(bridge.estimates(self.plain_real), self.plain_stats, NOW_US, rows=3 * self.rows)

    @cached_property
    def conversation_prompts(self) -> DataFrame:
        return bridge.conversation_prompts(self.spark, self.sf_dir)


def query(fn: Callable[[Views], DataFrame]):
    """Register a query under its function name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Views(spark, sf_dir))
    QUERIES[fn.__name__] = run
    return fn


@query
def where_it_went(v: Views) -> DataFrame:
    return reports.by_category(v.enriched)


@query
def totals(v: Views) -> DataFrame:
    return reports.totals(v.priced)


@query
def by_session(v: Views) -> DataFrame:
    return reports.by_session(v.priced)


@query
def by_month(v: Views) -> DataFrame:
    return reports.by_month(v.priced)


@query
def top_tasks(v: Views) -> DataFrame:
    return reports.top_tasks(v.stats)


@query
def calls_span(v: Views) -> DataFrame:
    return reports.time_span(v.calls)


@query
def filtered_projects(v: Views) -> DataFrame:
    """Seven hours of the projects whose names hold a text, whatever its case."""
    start = bridge.START_US
    picked = reports.filter_calls(v.priced, start + 2 * 3_600_000_000, start + 9 * 3_600_000_000, "P1")
    return picked.groupBy("project").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.min("t_us").alias("first_us"))


@query
def finished_tasks(v: Views) -> DataFrame:
    return tasks.finished_only(v.plain_real).select("task_id", "session_key", "last_us")


@query
def families_with_declared(v: Views) -> DataFrame:
    """Guessed families, and declared ones in their place where a tag names one task."""
    return tasks.with_declared(v.real.select("source", c("task_id").cast("string").alias("task_id"), "family"), declared_families(v))


@query
def price_prefix_join(v: Views) -> DataFrame:
    priced = tasks.enrich(v.calls, bridge.PRICES.frame(v.spark))
    return priced.groupBy("model", "price_key").agg(
        F.count(F.lit(1)).alias("calls"), dollars(exact_sum("cost_p"), 4).alias("cost"))


@query
def task_ranks(v: Views) -> DataFrame:
    return tasks.task_ranks(v.plain_real).select("task_id", "session_key", "rank")


@query
def anonymized_sessions(v: Views) -> DataFrame:
    return reports.anonymized(reports.by_session(v.priced)).select("session_name", "project_name", "turns", "tokens")


@query
def top_per_group(v: Views) -> DataFrame:
    top = reports.top_per_group(v.plain_stats.filter("tracked"), ["project"], [c("cost_p").desc(), c("task_id")], 3)
    return top.select("project", "task_id", dollars(c("cost_p"), 4).alias("cost"), "rank")


@query
def cache_events(v: Views) -> DataFrame:
    return cache.cache_events(v.pairs).select(
        "turn_id", "session_key", "kind", "lost_tokens", dollars(c("extra_p"), 8).alias("extra_cost"), "gap_us")


@query
def cache_summary(v: Views) -> DataFrame:
    return cache.cache_summary(cache.cache_events(v.pairs))


@query
def expiries(v: Views) -> DataFrame:
    return cache.expiries(cache.call_pairs(v.calls)).select("turn_id", "session_key", "model", "gap_us", "ttl", "context", "read")


@query
def ttl_in_force(v: Views) -> DataFrame:
    return cache.ttl_in_force(v.calls)


NOW_US = bridge.START_US + 12 * 3600 * 1_000_000


@query
def cache_clock(v: Views) -> DataFrame:
    return cache.cache_clock(v.calls, NOW_US)


@query
def break_causes(v: Views) -> DataFrame:
    return cache.break_causes(v.written_pairs)


@query
def prefix_writes(v: Views) -> DataFrame:
    return cache.prefix_writes(v.written_pairs)


@query
def other_session_active(v: Views) -> DataFrame:
    return v.survivors.select("turn_id", "session_key", "model", "read", "other_active")


@query
def expiry_survivors(v: Views) -> DataFrame:
    return cache.expiry_survivors(v.survivors)


def _shape_pairs(v: Views) -> DataFrame:
    main = tasks.main_calls(cache.with_subs_before(v.priced))
    indexed = scan(main, ["session_key"], ["t_us", "turn_id"], call_index=running_sum(F.lit(1).cast("bigint"), inclusive=False))
    sizes = tasks.main_calls(v.calls).groupBy("session_key").agg(F.count(F.lit(1)).alias("calls_in_session"))
    return cache.call_pairs(indexed.join(sizes, "session_key"), cache.prefix_file_writes(v.files), 2 * v.rows)


@query
def break_shape(v: Views) -> DataFrame:
    return cache.break_shape(_shape_pairs(v))


@query
def break_concentration(v: Views) -> DataFrame:
    return cache.break_concentration(v.written_pairs)


@query
def tool_lift(v: Views) -> DataFrame:
    return cache.tool_lift(v.written_pairs, v.tools)


@query
def counter_checks(v: Views) -> DataFrame:
    return v.checks


@query
def counter_coverage(v: Views) -> DataFrame:
    return reconcile.coverage(v.lined, v.snapshots)


@query
def snapshot_increments(v: Views) -> DataFrame:
    return reconcile.increments(v.series).select(
        "session_key", "snapshots", "pairs", "calls", "ours", "counter", "offset", "restarts")


@query
def gap_shape(v: Views) -> DataFrame:
    return reconcile.gap_shape(v.series)


@query
def suffix_match(v: Views) -> DataFrame:
    return reconcile.suffix_match(v.lined, v.snapshots).select(
        "session_key", "last_calls", "of", "since_us", "tail_o_output", "tail_c_output")


@query
def session_status(v: Views) -> DataFrame:
    return v.verdicts.select("session_key", "status", "pairs", "ours", "counter", "kind", "last_calls", "of", "restarts")


@query
def floor_gap(v: Views) -> DataFrame:
    return reconcile.floor_gap(v.verdicts)


@query
def unresolved_sessions(v: Views) -> DataFrame:
    rows = reconcile.gaps(v.verdicts)
    return rows.orderBy(F.abs(F.coalesce("input_gap_pct", F.lit(0))).desc(), "session_key").limit(15)


@query
def checks_summary(v: Views) -> DataFrame:
    sessions = v.calls.select("session_key").distinct().agg(F.count(F.lit(1)).alias("n"))
    return reconcile.summary(v.verdicts, sessions.scalar())


@query
def one_sided_models(v: Views) -> DataFrame:
    # the counter of every 5th session names its models differently
    odd = v.snapshots.withColumn("model", F.when(c("session_key") % 5 == 0, F.concat("model", F.lit("-x")))
                                 .otherwise(F.concat("model", F.lit("[1m]"))))
    return reconcile.one_sided_models(reconcile.counter_checks(v.lined, odd))


@query
def session_diagnosis(v: Views) -> DataFrame:
    return reconcile.unpivoted(v.checks)


@query
def version_status(v: Views) -> DataFrame:
    sessions = v.calls.groupBy("session_key").agg(F.min("version").alias("version"))
    return reconcile.by_version(v.verdicts, sessions)


@query
def single_version_status(v: Views) -> DataFrame:
    # sessions of every 11th user saw a second version
    seen = v.calls.select("session_key", F.when((c("session_key") % 11 == 0) & (c("turn_id") % 2 == 0), "v9")
                          .otherwise(c("version")).alias("version"))
    return reconcile.by_single_version(v.verdicts, seen)


@query
def turn_distribution(v: Views) -> DataFrame:
    return scores.distribution(v.plain_real, [], "turns_main").select("n", "lo", "p50", "hi", "ratio", "spread")


@query
def turns_by_family(v: Views) -> DataFrame:
    every = v.real.withColumn("family", F.explode(F.array(c("family"), F.lit("all"))))
    main = scores.distribution(every, ["family"], "turns_main")
    calls = scores.distribution(every, ["family"], "turns").select("family", c("p50").alias("all_p50"), c("hi").alias("all_hi"))
    return main.join(calls, "family").withColumn("verdict", scores.verdict(c("n"), c("spread"), c("ratio")))


@query
def backtest_turns(v: Views) -> DataFrame:
    return backtest.backtest_turns(v.real, v.rows)


def _rank_labels(v: Views) -> DataFrame:
    from callmeter.functions.labels import rank_slice

    ranked = tasks.task_ranks(v.plain_real)
    return ranked.select(F.lit("rank").alias("sign"), rank_slice(c("rank")).alias("label"), "session_key", "task_id", "started_us",
                         c("turns_main").alias("y"))


@query
def leak_free_by_slice(v: Views) -> DataFrame:
    done = backtest.sliced(_rank_labels(v), rows=v.rows)
    return done.select("task_id", "label", "n_slice", "n_before", "fell_back",
                       *[F.round(n, 6).alias(n) for n in ("lo", "mid", "hi", "b_lo", "b_mid", "b_hi")])


@query
def interval_metrics(v: Views) -> DataFrame:
    return scores.interval_metrics(backtest.turn_items(v.plain_real, v.rows).filter(~c("spread")), ["session_key"])


@query
def bootstrap_ci(v: Views) -> DataFrame:
    return scores.bootstrap(scores.measures(backtest.turn_items(v.plain_real, v.rows).filter(~c("spread"))))


@query
def survival_by_k(v: Views) -> DataFrame:
    return backtest.survival(v.plain_real)


@query
def turns_ahead_backtest(v: Views) -> DataFrame:
    return scores.interval_metrics(backtest.turns_ahead_items(v.plain_real, rows=v.rows), ["k"])


@query
def turns_ahead(v: Views) -> DataFrame:
    return live.turns_ahead(v.plain_stats, v.calls, v.tools)


@query
def early_signs(v: Views) -> DataFrame:
    return scores.five_numbers(signs.early_signs(v.plain_real, v.calls, v.tools), ["sign", "label"], "y")


@query
def context_growth(v: Views) -> DataFrame:
    grew = backtest.growth(v.calls.filter("tracked"))
    return grew.groupBy("task_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("grew").alias("grew"),
                                       F.count(F.when(c("grew") < 0, 1)).alias("shrank"))


@query
def merge_followups(v: Views) -> DataFrame:
    merged = signs.merge_followups(v.prompted)
    return merged.select("session_key", "task_id", "turns_main", "turns", "tasks", dollars(c("cost_p"), 4).alias("cost"))


@query
def followup_study(v: Views) -> DataFrame:
    return signs.followup_study(v.prompted)


@query
def pre_send_signs(v: Views) -> DataFrame:
    return signs.top_labels(signs.pre_send_signs(v.prompted), "turns_main", 12)


@query
def context_signs(v: Views) -> DataFrame:
    return signs.top_labels(signs.context_signs(v.prompted, v.tools), "turns_main", 8)


@query
def sign_pass_rule(v: Views) -> DataFrame:
    labels = signs.context_signs(v.prompted, v.tools).withColumnRenamed("turns_main", "y")
    return backtest.judge_signs(backtest.sliced(labels, rows=v.rows * 6))


@query
def interval_recalibration(v: Views) -> DataFrame:
    return backtest.recalibration(v.plain_real, v.rows)


@query
def cost_methods(v: Views) -> DataFrame:
    return scores.interval_metrics(backtest.cost_methods(v.plain_real, backtest.growth(v.calls), v.rows), ["method"], wide=True)


@query
def cost_correction(v: Views) -> DataFrame:
    return scores.interval_metrics(backtest.cost_correction(v.plain_real, v.rows), ["method"], wide=True)


@query
def dedup_calls(v: Views) -> DataFrame:
    d = reconstruct.dedup_calls(v.parsed)
    return d.select(F.substring("key", 2, 20).cast("bigint").alias("turn_id"), c("first.model").alias("model"),
                    *[c(f"usage.{n}").alias(n) for n in reconstruct.USAGE], "lines")


@query
def duplication_ratio(v: Views) -> DataFrame:
    return reconstruct.duplication_audit(v.parsed)


@query
def lines_per_call(v: Views) -> DataFrame:
    return reconstruct.lines_per_call(v.parsed)


@query
def task_chain(v: Views) -> DataFrame:
    roots = chains.nearest_prompt(reconstruct.line_nodes(v.parsed))
    first = reconstruct.dedup_calls(v.parsed).select("session_key", "key", c("first.uuid").alias("uuid"))
    return first.join(dealt(roots), ["session_key", "uuid"], "left").select(
        F.substring("key", 2, 20).cast("bigint").alias("turn_id"), F.coalesce(c("root_prompt").cast("bigint"), F.lit(-1)).alias("task_id"))


@query
def trigger_walk(v: Views) -> DataFrame:
    calls = cut(reconstruct.dedup_calls(v.parsed).select("session_key", "key", "first.parent", "first.thread"))
    walk, _ = chains.trigger_walk(calls.select("session_key", "key", "parent"), reconstruct.line_nodes(v.parsed))
    both = walk.join(dealt(calls.select("session_key", "key", "thread")), ["session_key", "key"])
    trigger = (F.when(c("thread") != "main", "subagent").when(c("outcome") == "prompt", "user_turn").when(c("has_ids"), "tool_call")
               .otherwise("user_turn"))
    return both.select(F.substring("key", 2, 20).cast("bigint").alias("turn_id"), trigger.alias("trigger"),
                       F.when(c("thread") == "main", c("chars")).alias("added_chars"))


@query
def json_tolerant_scan(v: Views) -> DataFrame:
    parsed = reconstruct.parse(bridge.damaged_lines(v.events))
    return reports.parse_quality(reconstruct.line_outcomes(parsed))


@query
def cross_session_dedup(v: Views) -> DataFrame:
    rows = v.calls.select("source", "turn_id", "session_key", "output")
    resumed = rows.filter(c("turn_id") % 3 == 0).withColumn("session_key", c("session_key") + 100000)
    return reconstruct.first_owner(rows.unionByName(resumed), ["source", "turn_id"]).groupBy("session_key").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("output").alias("output"))


@query
def rereads(v: Views) -> DataFrame:
    return files.reread_calls(v.files).select("turn_id", "session_key", "path")


@query
def unused_files(v: Views) -> DataFrame:
    return files.unused_files(v.files, v.calls)


@query
def edit_rate(v: Views) -> DataFrame:
    return files.edit_rate(v.files, v.families)


@query
def chars_per_token(v: Views) -> DataFrame:
    return forecast.chars_per_token(v.calls).select(F.round("ratio", 6).alias("ratio"), "samples")


@query
def next_call_input(v: Views) -> DataFrame:
    return v.asked.select("prompt_id", "session_key", "model", "input_next", "cached", "to_write", "ttl", "warm", "gap_us",
                          dollars(c("floor_p"), 8).alias("floor_cost"), dollars(c("warm_p"), 8).alias("warm_cost"))


@query
def basis_choice(v: Views) -> DataFrame:
    return v.chosen.select("prompt_id", "basis", "label", "samples", "rank_next", *[F.round(n, 6).alias(n) for n in ("lo", "p50", "hi", "all_p50")])


@query
def estimate_floor_ceiling(v: Views) -> DataFrame:
    return forecast.frame(v.chosen).select("prompt_id", "floor_cost", "ceiling_turns", "ceiling_input", "ceiling_output", "ceiling_cost",
                                           "cost_lo", "cost_p50", "cost_hi")


@query
def cost_state(v: Views) -> DataFrame:
    return forecast.cost_state(v.asked, cache.expiries(cache.call_pairs(v.calls)))


@query
def warning_flags(v: Views) -> DataFrame:
    return forecast.warning_flags(v.asked, v.pairs, files.unused_files(v.files, v.calls), forecast.family_sub_share(v.real))


@query
def session_alerts(v: Views) -> DataFrame:
    lines = reconstruct.line_outcomes(reconstruct.parse(bridge.damaged_lines(v.events)))
    return live.session_alerts(v.priced, v.verdicts, lines.withColumn("session_key", c("session_key").cast("long")))


@query
def settle_estimates(v: Views) -> DataFrame:
    return v.settled.select("est_id", "status", "task_id", "finished")


@query
def scorecard(v: Views) -> DataFrame:
    return settle.scorecard(bridge.estimates(v.plain_real), settle.outcomes(v.settled, v.stats))


@query
def computed_backtest(v: Views) -> DataFrame:
    chars = bridge.task_prompts(v.plain_stats).select("source", "task_id", F.length("text").alias("chars"))
    return settle.computed_backtest(v.calls, chars, forecast.chars_per_token(v.calls))


@query
def family_crosstab(v: Views) -> DataFrame:
    said = bridge.task_prompts(v.plain_stats).select("source", "task_id", text.family_from_text(c("text")).alias("text_family"))
    return v.real.join(said, ["source", "task_id"]).groupBy("text_family", "family").agg(
        F.count(F.lit(1)).alias("tasks"), F.count(F.when(c("text_family") == c("family"), 1)).alias("agree"),
        F.percentile("turns_main", F.lit(0.5)).alias("turns_p50"))


@query
def prompt_words(v: Views) -> DataFrame:
    rows = neighbours.word_rows(v.conversation_prompts, "prompt_id", "text")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("prompts"))


@query
def prompt_features(v: Views) -> DataFrame:
    return v.conversation_prompts.select("prompt_id", *[x.alias(n) for n, x in text.features(c("text")).items()])


@query
def family_from_text(v: Views) -> DataFrame:
    return v.conversation_prompts.groupBy(text.family_from_text(c("text")).alias("family")).agg(F.count(F.lit(1)).alias("prompts"))


@query
def nearest_prompts(v: Views) -> DataFrame:
    top = neighbours.nearest_earlier(v.conversation_prompts.withColumn("o", c("prompt_id")), "prompt_id", "o", "text", k=5)
    return neighbours.complete_only(top, "prompt_id", 5).select("prompt_id", "near_id", F.round("sim", 6).alias("sim"), "rank")


# fixed values: terms the scan looks for
DENIED = ("password", "internal use", "secret")


@query
def sensitive_text_scan(v: Views) -> DataFrame:
    docs = v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").select(F.concat(F.lit("d"), c("doc_id")).alias("id"), c("text"))
    whole = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    pages = v.spark.read.parquet(f"{v.sf_dir}/pages.parquet").select(F.concat(F.lit("p"), c("page_id")).alias("id"), whole.alias("text"))
    found = textscan.scan_text(docs.unionByName(pages), "id", "text", list(DENIED), allowed=("example.com", "example.net"))
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("id").alias("texts"))


@query
def event_contrast(v: Views) -> DataFrame:
    pairs = contrast.expiry_pairs(cache.expiries(cache.call_pairs(v.calls)))
    marks = v.calls.select("session_key", "t_us", F.concat(F.lit("type:"), c("event_type")).alias("kind"), "model", "version",
                           F.concat(F.lit("b"), c("task_no") % 2).alias("branch"), *[n for n in ("slice",) if n in v.calls.columns])
    return contrast.event_contrast(pairs, contrast.events_between(pairs, marks, 3 * v.rows))


TREE_SIGNS = ["rank in session", "previous task's turns", "idle since previous task", "previous task edited files", "prompt is a question"]


@query
def quantile_tree(v: Views) -> DataFrame:
    both = signs.pre_send_signs(v.prompted).unionByName(signs.context_signs(v.prompted, v.tools))
    rows = v.plain_real.select("session_key", "task_id", "started_us", c("turns_main").alias("y"))
    return scores.interval_metrics(tree.quantile_tree(rows, both, TREE_SIGNS, v.rows), ["method"])


@query
def declared_families(v: Views) -> DataFrame:
    """Tags name a task by the first digits of its id; some fit several tasks and count for none."""
    named = v.plain_real.select("source", c("task_id").cast("string").alias("task_id"), "started_us", c("task_id").alias("no"))
    tags = named.filter("no % 3 = 0").select("source", F.substring(c("task_id"), F.lit(1), (F.char_length("task_id") - c("no") % 2).cast("int")).alias("prefix"),
                                             F.when(c("no") % 5 < 2, "review").otherwise("question").alias("family"), c("started_us").alias("declared_at"))
    return tasks.resolve_tags(named, tags)


@query
def picked_sessions(v: Views) -> DataFrame:
    """Prompts that name a session by its first digits, by a folder or not at all."""
    sessions = v.calls.groupBy("session_key").agg(F.min("project").alias("cwd"), F.max("t_us").alias("last_us")).withColumn("session_id", c("session_key").cast("string"))
    task, one = c("task_id"), F.substring(c("session_key").cast("string"), 1, 1)
    prompts = v.plain_real.select(task.alias("prompt_id"), F.when(task % 3 == 0, one).alias("prefix"), F.when(task % 2 == 0, c("project")).alias("cwd"))
    return forecast.pick_session(prompts, sessions).select("prompt_id", "session_key")


# ------------------------------------------------------------------ streams over the same data


@query
def stream_dedup_calls(v: Views) -> DataFrame:
    ev = streams.read_files(v.spark, v.sf_dir, v.events.schema, name_filter="events.parquet")
    out = 100 + F.floor(c("value") * 10).cast("bigint")
    lines = ev.select(c("user_id").alias("session_key"), c("event_id").alias("key"), c("event_type").alias("model"), out.alias("full"),
                      F.explode(F.sequence(F.lit(1), (1 + c("event_id") % 4).cast("int"))).alias("line_no"))
    half = F.when(c("line_no") == 1 + c("key") % 4, c("full")).otherwise(F.expr("full div 2"))
    emitted = streams.drain(streams.call_stream(lines.withColumn("output", half)), "update", "dedup")
    return streams.latest(emitted, ["session_key", "key"]).select(c("key").alias("turn_id"), "session_key", "model", "output", "lines")


@query
def stream_corrections(v: Views) -> DataFrame:
    """Lines of calls over four steps: some lines are cut short at first and land whole later, some sub-agent results come last of all."""
    i, n = c("turn_id"), (1 + c("turn_id") % 4).cast("int")
    base = cut(v.calls.select("session_key", "turn_id", "t_us", "model", "output"))
    place = base.withColumn("place", F.explode(F.sequence(F.lit(1), n)))
    full = F.when(c("place") == n, c("output")).otherwise(F.expr("output div 2"))
    broken = (i % 5 == 2) & (c("place") == n)
    piece = lambda df, step, output, final, at: df.select(
        "session_key", i.alias("key"), at.alias("place"), "t_us", "model", output.cast("long").alias("output"), final.cast("long").alias("final_output"), step.cast("int").alias("step"))
    none = F.lit(None)
    rows = piece(place, i % 2, F.when(~broken, full), none, c("place")).unionByName(piece(place.filter(broken), F.lit(2), full, none, c("place"))).unionByName(
        piece(base.filter(i % 7 == 3), F.lit(3), none, c("output") + 7, none.cast("int")))
    rows, path = cut(rows), scratch_path(v.spark, "pieces")
    files = max(1, -(-3 * v.rows // 1_000_000))
    for step in range(4):  # steps follow each other by the time of their files
        rows.filter(c("step") == step).drop("step").repartition(files).write.mode("append").parquet(path)
    store = corrections.CallStore(v.spark, scratch_path(v.spark, "corrected"))
    corrections.correct(streams.read_files(v.spark, path, rows.drop("step").schema, files_per_trigger=files), store)
    return store.calls().select(c("key").alias("turn_id"), "session_key", "model", "output", "lines", "exact", "versions")


def _landed_calls(v: Views) -> tuple[DataFrame, str]:
    """The calls in eight steps out of time order, and how late they come."""
    rows = cut(v.priced.drop("slice"))
    at = streams.landed(rows, "calls", trigger="user_turn", tracked=True)
    return streams.read_files(v.spark, at.path, rows.schema, files_per_trigger=at.files), at.delay


@query
def stream_live_sessions(v: Views) -> DataFrame:
    calls, _ = _landed_calls(v)
    emitted = streams.drain(streams.session_stream(calls.filter(c("session_key") != streams.MARK_SESSION)), "update", "live")
    return streams.latest(emitted, ["session_key"]).select(
        "session_key", "ttl", "calls", c("last.tokens").alias("tokens"), c("last.model").alias("model"), dollars(c("cost_p"), 4).alias("cost"))


@query
def stream_session_state(v: Views) -> DataFrame:
    """The last row of each session from the stateful stream, and when its lifetime ended without a further call."""
    calls, delay = _landed_calls(v)
    emitted = streams.drain(sessions.live_sessions(calls, delay, buckets=streams.buckets_for(v.rows)), "update", "session-state").filter(c("session_key") != streams.MARK_SESSION)
    last = F.struct("turn_id", "task_id", "k", "calls", "unpriced", "cost_p", "context", "cache_missed", "ttl")
    ended = emitted.groupBy("session_key").agg(F.max_by(last, F.when(c("kind") == "call", c("batch"))).alias("l"),
                                               F.max(F.when(c("kind") == "expired", c("at_us"))).alias("expired_us"))
    return ended.select("session_key", "l.*", "expired_us").withColumn("cost", dollars(c("cost_p"), 4)).drop("cost_p")


@query
def stream_cache_events(v: Views) -> DataFrame:
    return streams.drain(streams.cache_event_stream(*_landed_calls(v), buckets=streams.buckets_for(v.rows)), "append", "cache").drop("batch")


@query
def stream_finished_tasks(v: Views) -> DataFrame:
    return streams.drain(streams.finished_task_stream(*_landed_calls(v), buckets=streams.buckets_for(v.rows)), "append", "tasks").drop("batch")


@query
def stream_links(v: Views) -> DataFrame:
    real = cut(v.plain_real.select("session_key", "task_id", "started_us"))
    est = cut(bridge.estimates(v.plain_real).select("est_id", "session_key", "made_us"))
    asked, told = streams.landed(est, "estimates", "made_us"), streams.landed(real, "tasks", "started_us")
    e = streams.read_files(v.spark, asked.path, est.schema, asked.files)
    t = streams.read_files(v.spark, told.path, real.schema, told.files)
    linked = streams.drain(streams.link_stream(e, t, asked.delay, told.delay), "append", "links")
    return streams.first_links(linked.filter(c("session_key") != streams.MARK_SESSION))

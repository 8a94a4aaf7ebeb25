"""Streaming forms of the live figures; each gives what its batch operator gives on the same calls."""

from __future__ import annotations

import math
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callmeter.functions.labels import MIN_CACHEABLE, ttl_of_write
from callmeter.operators.cache import DEFAULT_TTL, SECOND_US
from callmeter.operators.settle import FINISHED_US, LINK_US, SLACK_US
from callmeter.session import scratch_path

c = F.col
YEAR_US = 365 * 24 * 3600 * SECOND_US


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, name_filter: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream. The source never reads a path twice: growing logs must land as new files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str, label: str, timeout_s: int | None = None) -> DataFrame:
    """Run a stream over what is there, and give back what it emitted with the batch it came from.

    Each batch is written to the shared folder; nothing passes through the driver. The input is bounded, so the stream ends by
    itself; `timeout_s` gives up earlier.
    """
    spark = stream.sparkSession
    out, marks = scratch_path(spark, label), scratch_path(spark, label + "-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start())
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {label} still running after {timeout_s} s")
    return spark.read.option("basePath", out).parquet(out).drop("n")


def latest(emitted: DataFrame, key: list[str]) -> DataFrame:
    """Last version of each row of an update stream; the cut runs before the shuffle."""
    order = Window.partitionBy(*key).orderBy(c("batch").desc())
    return emitted.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "batch")


def call_stream(lines: DataFrame) -> DataFrame:
    """Calls from lines that arrive in pieces: (session_key, key, line_no, output, ...) -> one updated row per call."""
    return lines.groupBy("session_key", "key").agg(
        F.max_by("output", F.struct("output", "line_no")).alias("output"), F.count(F.lit(1)).alias("lines"),
        F.min_by("model", "line_no").alias("model"))


def session_stream(calls: DataFrame) -> DataFrame:
    """Live state per session: last main call, lifetime in force, calls and cost so far."""
    main = c("trigger") != "subagent"
    at = F.when(main, F.struct("t_us", "turn_id"))
    ttl = ttl_of_write(c("cache_write"), c("cache_write_1h"))
    return calls.groupBy("session_key").agg(
        F.max_by(F.struct("t_us", (c("input_total") + c("output")).alias("tokens"), "model"), at).alias("last"),
        F.coalesce(F.max_by(ttl, F.when(ttl.isNotNull(), at)), F.lit(DEFAULT_TTL).cast("bigint")).alias("ttl"),
        F.count(F.lit(1)).alias("calls"), F.sum(c("cost_p").cast("decimal(20,0)")).alias("cost_p"))


#: Calls a bucket of sessions, by which the queries choose the number of buckets, and the least number.
BUCKET_ROWS, BUCKETS = 50_000, 64
NO_SESSION = -1


def buckets_for(rows: int) -> int:
    """How many buckets of sessions a stream over so many calls should keep."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def _timed(calls: DataFrame, columns: list[str], delay: str, buckets: int) -> DataFrame:
    """Main-thread calls with event time, the bucket of their session and nothing but the columns that are kept in state; calls without session have a bucket of their own."""
    numbers = [F.coalesce(c(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in ("session_key", *columns)]
    main = calls.filter(c("trigger") != "subagent").withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay)
    bucket = F.when(c("session_key").isNull(), NO_SESSION).otherwise(F.pmod(F.xxhash64("session_key"), F.lit(buckets))).alias("bucket")
    return main.select(bucket, "ts", *numbers)


BUCKET_STATE = "heads binary, held binary"


class _Due(NamedTuple):
    """What a trigger brings for the sessions of a bucket that have calls or whose time has come."""
    heads: np.ndarray  # a row each: session, then what is kept of it; sorted by session
    rows: np.ndarray  # calls up to the watermark: session, then the columns; sorted by session, t_us, turn_id
    place: np.ndarray  # the row of heads that each call belongs to
    until_us: int


def _before(rows: np.ndarray, carried: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each row's predecessor in its session, what was carried for a session's first."""
    return np.where(first, carried, np.roll(rows, 1))


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])


def _bucket_step(work, fresh: tuple[int, ...], columns: list[str], key, frames, state: GroupState):
    """One trigger of a bucket: `work` gets all sessions that are due at once, and each session keeps its own head, calls held back and time to wake.

    `work` takes a _Due and gives rows to emit, the new heads and when each wakes without further calls (0: its state goes).
    A head is the session, what `fresh` begins with, and the time to wake in milliseconds.
    """
    width = len(fresh) + 2
    heads, held = (np.frombuffer(b, np.int64).reshape(-1, w) for b, w in zip(state.get if state.exists else (b"", b""), (width, len(columns) + 1)))
    now_ms = state.getCurrentWatermarkMs()
    new = [f[["session_key", *columns]].to_numpy(np.int64) for f in frames if len(f)]
    keys = np.unique(np.concatenate([heads[:, 0][heads[:, -1] < now_ms], *[f[:, 0] for f in new]]))
    ours = np.isin(heads[:, 0], keys)
    unknown = np.setdiff1d(keys, heads[:, 0], assume_unique=True)
    begun = np.column_stack([unknown, np.tile(np.array([*fresh, 0], np.int64), (len(unknown), 1))])
    mine = np.concatenate([heads[ours], begun])
    mine = mine[np.argsort(mine[:, 0])]
    waiting = np.isin(held[:, 0], keys)
    rows = np.concatenate([held[waiting], *new])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]  # session, t_us and turn_id stand first
    due = rows[:, 1] <= now_ms * 1000
    later, rows = rows[~due], rows[due]
    out, kept, wake_us = work(_Due(mine[:, :-1], rows, np.searchsorted(keys, rows[:, 0]), now_ms * 1000))
    if len(out):
        if key[0] == NO_SESSION:
            out["session_key"] = None
        yield out
    first = _starts(later[:, 0])
    at = np.searchsorted(keys, later[first, 0])
    wake_us = wake_us.copy()
    wake_us[at] = np.where(wake_us[at] > 0, np.minimum(wake_us[at], later[first, 1]), later[first, 1])
    stays = wake_us > 0
    stays[at] = True
    wake_ms = np.maximum(-(-wake_us // 1000), now_ms + 1)
    heads = np.concatenate([heads[~ours], np.column_stack([kept, wake_ms])[stays]])
    held = np.concatenate([held[~waiting], later])
    if not len(heads):
        if state.exists:
            state.remove()
        return
    state.update((heads.tobytes(), held.tobytes()))
    state.setTimeoutTimestamp(max(int(heads[:, -1].min()), now_ms, 1))


def _by_bucket(calls: DataFrame, work, fresh: tuple[int, ...], columns: list[str], schema: str) -> DataFrame:
    return calls.groupBy("bucket").applyInPandasWithState(
        partial(_bucket_step, work, fresh, columns), schema, BUCKET_STATE, "append", GroupStateTimeout.EventTimeTimeout)


NONE = -1
EVENT_COLUMNS = ["t_us", "turn_id", "input_total", "cache_read", "cache_write", "cache_write_1h", "after_compaction"]
EVENT_SCHEMA = "session_key long, turn_id long, kind string, lost_tokens long, gap_us long"
EVENT_FRESH = (NONE, 0, DEFAULT_TTL)  # t_us, context, lifetime in force


def _cache_work(forget_us: int, due: _Due) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    session, t, turn, total, read, write, write_1h, compacted = due.rows.T
    _, h_t, h_total, h_ttl = due.heads[due.place].T
    first, n = _starts(session), np.arange(len(session))
    written = np.where(write > 0, np.where(write_1h > 0, 3600, 300), 0)
    newest = np.maximum.accumulate(np.where(written > 0, n, NONE))
    begin = np.maximum.accumulate(np.where(first, n, 0))
    in_force = np.where(newest < begin, h_ttl, written[newest])
    p_t, p_total, p_ttl = _before(t, h_t, first), _before(total, h_total, first), _before(in_force, h_ttl, first)
    gap = t - p_t
    lost = (p_t != NONE) & (p_total >= MIN_CACHEABLE) & (total >= 0.5 * p_total) & (compacted == 0) & (read < 0.5 * p_total)
    kind = np.where(gap > p_ttl * SECOND_US, "expired", "break")
    out = pd.DataFrame({"session_key": session[lost], "turn_id": turn[lost], "kind": kind[lost], "lost_tokens": (p_total - read)[lost], "gap_us": gap[lost]})
    heads, last = due.heads.copy(), np.roll(first, -1)
    heads[due.place[last], 1:] = np.column_stack([t, total, in_force])[last]
    # a session without a call up to here has calls that wait
    return out, heads, np.where((heads[:, 1] != NONE) & (heads[:, 1] + forget_us > due.until_us), heads[:, 1] + forget_us, 0)


def cache_event_stream(calls: DataFrame, delay: str = "10 minutes", forget_us: int = 30 * 24 * 3600 * SECOND_US, buckets: int = BUCKETS) -> DataFrame:
    """Lost caches as the watermark passes their calls, so files may arrive out of order by up to `delay`.

    The state of a session is its previous main call, the lifetime in force and the calls the watermark has not passed. It goes
    when the session has been silent for forget_us: a call after that starts anew. Calls later than `delay` are left to the batch operator.
    The sessions of a bucket share a row of the state store and are worked off together; a stream keeps its number of buckets for life.
    """
    return _by_bucket(_timed(calls, EVENT_COLUMNS, delay, buckets), partial(_cache_work, forget_us), EVENT_FRESH, EVENT_COLUMNS, EVENT_SCHEMA)


TASK_COLUMNS = ["t_us", "turn_id", "task_id"]
TASK_SCHEMA = "session_key long, task_id long, started_us long, last_us long, turns_main long, closed_by string"
TASK_FRESH = (NONE, 0, 0, 0)  # task, start, end and turns of the open stretch


def _task_work(due: _Due) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    # each call as a stretch of one turn, the open stretch of its session before them: session, task, start, end, turns
    calls = np.column_stack([due.rows[:, 0], due.rows[:, 3], due.rows[:, 1], due.rows[:, 1], np.ones(len(due.rows), np.int64)])
    runs = np.concatenate([due.heads[due.heads[:, 4] > 0], calls])
    session, task, start, last, turns = runs[np.argsort(runs[:, 0], kind="stable")].T
    begins = _starts(session)
    begins[1:] |= (task[1:] != task[:-1]) | (start[1:] - last[:-1] > FINISHED_US)
    ends, begins = np.flatnonzero(np.roll(begins, -1)), np.flatnonzero(begins)
    session, task, start, last = session[begins], task[begins], start[begins], last[ends]
    turns = np.add.reduceat(turns, begins) if len(begins) else turns
    newest = np.roll(_starts(session), -1)
    followed = ~newest & (np.roll(start, -1) - last <= FINISHED_US)
    over = ~newest | (due.until_us > last + FINISHED_US)
    out = pd.DataFrame({"session_key": session[over], "task_id": task[over], "started_us": start[over], "last_us": last[over], "turns_main": turns[over],
                        "closed_by": np.where(followed, "next task", "silence")[over]})
    heads = np.column_stack([due.heads[:, 0], np.tile(np.array(TASK_FRESH, np.int64), (len(due.heads), 1))])
    heads[np.searchsorted(heads[:, 0], session[~over]), 1:] = np.column_stack([task, start, last, turns])[~over]
    return out, heads, np.where(heads[:, 4] > 0, heads[:, 3] + FINISHED_US + 1, 0)


def finished_task_stream(calls: DataFrame, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Stretches of tasks as they end: by the next task of their session, or after an hour of silence (event time).

    A task that goes on after an hour of silence gives one row per stretch; their turns add up. Files may arrive out of order by up
    to `delay`. A session without an open task or calls to wait for has no state. Buckets are those of `cache_event_stream`.
    """
    return _by_bucket(_timed(calls.filter("tracked"), TASK_COLUMNS, delay, buckets), _task_work, TASK_FRESH, TASK_COLUMNS, TASK_SCHEMA)


def link_stream(estimates: DataFrame, tasks: DataFrame, made_delay: str = "10 minutes", started_delay: str = "10 minutes") -> DataFrame:
    """Estimates with the tasks that start from 5 s before to 30 min after, as both arrive; without any, once the watermark rules them out."""
    e = estimates.withColumn("made_ts", F.timestamp_micros("made_us")).withWatermark("made_ts", made_delay)
    t = tasks.select(c("session_key").alias("t_session"), "task_id", "started_us").withColumn(
        "started_ts", F.timestamp_micros("started_us")).withWatermark("started_ts", started_delay)
    low = c("made_ts") - F.expr(f"INTERVAL {SLACK_US // SECOND_US} SECONDS")
    high = c("made_ts") + F.expr(f"INTERVAL {LINK_US // SECOND_US} SECONDS")
    near = (c("session_key") == c("t_session")) & (c("started_ts") >= low) & (c("started_ts") <= high)
    return e.join(t, near, "left_outer").select("est_id", "session_key", "made_us", "task_id", "started_us")


def first_links(linked: DataFrame) -> DataFrame:
    """Status of each estimate: linked to its first task, superseded by a newer estimate of that task, or unmatched."""
    task = F.when(c("task_id").isNotNull(), F.struct("started_us", "task_id"))
    first = linked.groupBy("est_id", "session_key", "made_us").agg(F.min(task).alias("t")).select("*", c("t.task_id").alias("task_id"))
    newest = first.filter("task_id IS NOT NULL").groupBy("session_key", "task_id").agg(
        F.max_by("est_id", F.struct("made_us", -c("est_id"))).alias("newest"))
    status = F.when(c("task_id").isNull(), "unmatched").when(c("newest") == c("est_id"), "linked").otherwise("superseded")
    named = first.join(newest, ["session_key", "task_id"], "left").withColumn("status", status)
    return named.select("est_id", "session_key", "status", F.when(c("status") == "linked", c("task_id")).alias("task_id"))


MARK_SESSION = -1


class Landed(NamedTuple):
    """A folder of files for a stream; one step of it is `files` files, and rows are late by `delay` at most."""
    path: str
    files: int
    delay: str


def landed(rows: DataFrame, label: str, time: str = "t_us", order: tuple[int, ...] = (0, 2, 1, 3, 5, 4, 7, 6), file_rows: int = 1_000_000, **mark) -> Landed:
    """Write a table for a stream to pick up: as many spans of time as `order` names, in that order, so that some arrive late.

    Last comes an end mark, one row of session -1 a year on, which moves the watermark past everything before it; `mark` are values
    it needs so that the stream doesn't leave it out.
    """
    path = scratch_path(rows.sparkSession, label)
    low, high, n = rows.agg(F.min(time), F.max(time), F.count(F.lit(1))).first()
    span = ((high or 0) - (low or 0)) // len(order) + 1
    files = max(1, math.ceil(n / len(order) / file_rows))
    for i in order:
        rows.filter(F.expr(f"({time} - {low or 0}) div {span}") == i).repartition(files).write.mode("append").parquet(path)
    values = {"session_key": MARK_SESSION, time: (high or 0) + YEAR_US} | mark
    rows.limit(1).withColumns({k: F.lit(v).cast(rows.schema[k].dataType) for k, v in values.items()}).write.mode("append").parquet(path)
    return Landed(path, files, f"{math.ceil(2 * span / SECOND_US)} seconds")

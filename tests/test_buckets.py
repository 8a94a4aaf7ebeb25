"""Streams whose sessions share buckets of state, against a plain loop over each session."""

import inspect
import random

import pytest

from callmeter.session import scratch_path
from callmeter.streaming import corrections, live

S = 1_000_000
COLUMNS = ("session_key long, t_us long, turn_id long, trigger string, tracked boolean, task_id long, input_total long, cache_read long, "
           "cache_write long, cache_write_1h long, after_compaction boolean")


@pytest.fixture(scope="module")
def calls():
    rng, rows, turn = random.Random(5), [], 0
    for session in [None, *range(1, 60)]:
        at = 10_000 * S + rng.randrange(5000) * S
        for _ in range(rng.randint(1, 25)):
            turn += 1
            at += rng.choice([0, 20, 400, 3_600, 3_601, 5_000, 40_000]) * S + rng.randint(0, 1)
            write = rng.choice([0, 0, 500])
            rows.append((session, at, turn, "user_turn", True, rng.randrange(3), rng.choice([100, 9_000, 10_000]), rng.choice([0, 9_000]), write,
                         rng.choice([0, write]), rng.random() < 0.1))
    return rows


def stretches(rows):
    out, runs = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        mine = runs.setdefault(r[0], [])
        if mine and mine[-1][0] == r[5] and r[1] - mine[-1][2] <= live.FINISHED_US:
            mine[-1][2:] = [r[1], mine[-1][3] + 1]
        else:
            mine.append([r[5], r[1], r[1], 1])
    for session, mine in runs.items():
        for i, x in enumerate(mine):
            next_by = i + 1 < len(mine) and mine[i + 1][1] - x[2] <= live.FINISHED_US
            out.append((session, *x, "next task" if next_by else "silence"))
    return sorted(out, key=str)


def lost(rows):
    out, state = [], {}
    for s, t, turn, _, _, _, total, read, write, write_1h, compacted in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        before, context, ttl = state.get(s, (None, 0, live.DEFAULT_TTL))
        if before is not None and context >= live.MIN_CACHEABLE and 2 * total >= context and not compacted and 2 * read < context:
            out.append((s, turn, "expired" if t - before > ttl * S else "break", context - read, t - before))
        state[s] = t, total, (3600 if write_1h > 0 else 300) if write > 0 else ttl
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 5])
def test_sessions_of_a_bucket_do_not_mix(spark, calls, buckets):
    rows = spark.createDataFrame(calls, COLUMNS)
    at = live.landed(rows, "calls", trigger="user_turn", tracked=True)
    stream = live.read_files(spark, at.path, rows.schema, files_per_trigger=at.files)
    done = live.drain(live.finished_task_stream(stream, at.delay, buckets=buckets), "append", "tasks").filter("not session_key <=> -1")
    assert sorted([tuple(r) for r in done.drop("batch").collect()], key=str) == stretches(calls)
    gone = live.drain(live.cache_event_stream(stream, at.delay, buckets=buckets), "append", "cache").filter("not session_key <=> -1")
    assert sorted([tuple(r) for r in gone.drop("batch").collect()], key=str) == lost(calls)


def test_state_has_a_row_a_bucket(spark, calls):
    path = scratch_path(spark, "calls")
    rows = spark.createDataFrame(calls, COLUMNS)
    rows.write.parquet(path)
    query = (live.cache_event_stream(live.read_files(spark, path, rows.schema), buckets=3).writeStream.outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, "state")).foreachBatch(lambda b, n: b.count()).start())
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_a_forgotten_session_starts_anew_beside_one_that_is_not(spark):
    call = lambda s, at, turn: (s, at * S, turn, "user_turn", True, 1, 10_000, 0, 0, 0, False)
    path = scratch_path(spark, "calls")
    for step in ([call(1, 10_000, 1), call(2, 10_900, 2)], [call(-1, 12_000, 3)], [call(-1, 12_001, 4)], [call(1, 12_300, 5), call(2, 12_301, 6)], [call(-1, 99_000, 7)]):
        spark.createDataFrame(step, COLUMNS).coalesce(1).write.mode("append").parquet(path)
    stream = live.read_files(spark, path, spark.createDataFrame([], COLUMNS).schema, files_per_trigger=1)
    out = live.drain(live.cache_event_stream(stream, "1 second", forget_us=1_500 * S, buckets=1), "append", "cache").filter("session_key > 0")
    assert [(r.session_key, r.turn_id, r.gap_us) for r in out.collect()] == [(2, 6, 1_401 * S)]


def test_a_bounded_input_is_read_to_its_end_however_long_it_takes():
    for run in (live.drain, corrections.correct):
        assert inspect.signature(run).parameters["timeout_s"].default is None

"""The stateful session stream: rows by call, expiry by timer in both clocks, late calls, state that goes."""

import random
import time

import pytest

from callmeter.session import scratch_path
from callmeter.streaming import live, sessions

S = 1_000_000
START = 10_000 * S  # a watermark begins at 0, and what is not after it is late
COLUMNS = "session_key long, t_us long, turn_id long, input_total long, output long, cache_read long, task_id long, cache_write long, cache_write_1h long, cost_p long, trigger string"


def call(session, second, turn, total=10_000, read=9_000, task=1, write=0, write_1h=0, cost=5, trigger="user_turn", base=START):
    return (session, base + second * S, turn, total, 10, read, task, write, write_1h, cost, trigger)


def land(spark, path, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, steps, **kw):
    for rows in steps:
        land(spark, path, rows)
    schema = spark.createDataFrame([], COLUMNS).schema
    out = live.drain(sessions.live_sessions(live.read_files(spark, path, schema, files_per_trigger=1), **kw), "update", "sessions")
    return sorted(out.filter("session_key > 0").collect(), key=lambda r: (r.session_key, r.batch, r.kind))


def mark(second):
    return [call(-1, second, 0)]


def test_replayed_logs_expire_by_the_watermark(spark):
    rows = run(spark, scratch_path(spark, "s"), [
        [call(1, 0, 1, write=100), call(1, 100, 2, task=2), call(2, 0, 7, write=100, write_1h=100, cost=None)],
        [call(1, 50, 3, task=2, cost=7)],  # late: the newest stays, turns and money add up
        [call(1, 250, 4, task=2, read=0, cost=1), call(1, 260, 5, trigger="subagent", cost=10**15)],
        mark(2000), mark(6000), mark(7000)], delay="1 second")
    one = [r for r in rows if r.session_key == 1]
    assert [(r.kind, r.turn_id, r.task_id, r.k, r.calls, int(r.cost_p)) for r in one] == [
        ("call", 2, 2, 1, 2, 10), ("call", 2, 2, 2, 3, 17), ("call", 4, 2, 3, 5, 10**15 + 18), ("expired", 4, 2, 3, 5, 10**15 + 18)]
    assert [r.cache_missed for r in one] == [False, False, True, True] and one[-1].at_us == START + (250 + 300) * S and one[-1].context == 10_010
    two = [r for r in rows if r.session_key == 2]
    assert [(r.kind, r.unpriced, r.ttl) for r in two] == [("call", 1, 3600), ("expired", 1, 3600)] and two[-1].at_us == START + 3600 * S


def test_a_call_in_time_puts_off_the_end_and_a_later_one_revives(spark):
    steps = [[call(1, 0, 1, write=1)], [call(1, 200, 2, write=1)], mark(450), mark(460), [call(1, 480, 3, write=1)], mark(900), mark(910), [call(1, 1000, 4)], mark(2000), mark(2010)]
    rows = run(spark, scratch_path(spark, "s"), steps, delay="1 second")
    assert [(r.kind, r.turn_id) for r in rows] == [("call", 1), ("call", 2), ("call", 3), ("expired", 3), ("call", 4), ("expired", 4)]


def test_state_goes_when_a_session_is_forgotten(spark):
    steps = [[call(1, 0, 1, write=1, cost=100)], mark(500), mark(2000), mark(2010), [call(1, 3000, 2, cost=1)], mark(3001)]
    rows = run(spark, scratch_path(spark, "s"), steps, delay="1 second", forget_us=1500 * S)
    assert [(r.kind, r.calls, int(r.cost_p)) for r in rows] == [("call", 1, 100), ("expired", 1, 100), ("call", 1, 1)]


def test_only_subagent_calls_and_nulls(spark):
    rows = run(spark, scratch_path(spark, "s"), [[call(1, 0, 1, trigger="subagent"), (1, START + 5 * S, 2, None, None, None, None, None, None, None, "user_turn")]], delay="1 second")
    assert [(r.kind, r.calls, r.unpriced, r.turn_id, r.k) for r in rows] == [("call", 2, 1, 2, 1)]


def test_sessions_under_way_expire_by_the_clock(spark):
    """Processing time; a second lasts a millisecond here, so the lifetime of 300 s ends 0.3 s after the call."""
    path, out, seen = scratch_path(spark, "s"), scratch_path(spark, "out"), []
    now = time.time_ns() // 1000
    land(spark, path, [call(1, 0, 1, write=1, base=now), call(2, 0, 2, write=1, base=now + 3600 * S)])
    stream = sessions.live_sessions(live.read_files(spark, path, spark.createDataFrame([], COLUMNS).schema), second_us=1000)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", out).trigger(processingTime="1 second").foreachBatch(
        lambda b, n: seen.extend((r.session_key, r.kind) for r in b.collect())).start()
    try:
        end = time.time() + 60
        while (1, "expired") not in seen and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(seen) == [(1, "call"), (1, "expired"), (2, "call")]


def test_buckets_of_sessions_give_what_each_session_gives_by_itself(spark):
    """calls in any order, twice, by sub-agents, without session, with sums beyond 64 bits; a plain loop over all calls so far."""
    rng, steps = random.Random(4), []
    for step in range(4):
        rows = [call(rng.choice([None, *range(1, 40)]), rng.randrange(3000), rng.randrange(60), rng.choice([100, 9_000, 10_000]), rng.choice([0, 4_000, 9_000]),
                     rng.randrange(3), rng.choice([0, 0, 50]), rng.choice([0, 50]), rng.choice([None, 1, 7 * 10**18]), rng.choice(["user_turn", "user_turn", "subagent"]))
                for _ in range(120)]
        steps.append(rows + rows[:5])
    path = scratch_path(spark, "s")
    for rows in [*steps, mark(20_000), mark(20_001)]:
        land(spark, path, rows)
    stream = live.read_files(spark, path, spark.createDataFrame([], COLUMNS).schema, files_per_trigger=1)
    out = [r for r in live.drain(sessions.live_sessions(stream, "2 hours", buckets=3), "update", "sessions").collect() if r.session_key != -1]
    number = {b: i for i, b in enumerate(sorted({r.batch for r in out if r.kind == "call"}))}
    got = {(r.session_key, number[r.batch] if r.kind == "call" else "end"): r for r in out}
    want = {}
    for i in range(len(steps)):
        for key in {r[0] for r in steps[i]}:
            so_far = [r for rows in steps[:i + 1] for r in rows if r[0] == key]
            main = sorted((r for r in so_far if r[-1] != "subagent"), key=lambda r: (-r[1], -r[2]))
            wrote = [r for r in main if r[7] > 0]
            ttl = 300 if not wrote or not wrote[0][8] else 3600
            last, prev = [*main, None, None][:2]
            missed = prev is not None and prev[3] >= live.MIN_CACHEABLE and 2 * last[5] < prev[3] <= 2 * last[3]
            want[key, i] = want[key, "end"] = (last and last[2], last and last[6], last and sum(r[6] == last[6] for r in main), len(so_far), sum(r[9] is None for r in so_far),
                                               sum(r[9] or 0 for r in so_far), last and last[3] + last[4], missed, ttl, last and last[1] + ttl * S)
    want = {k: v for k, v in want.items() if k[1] != "end" or v[0] is not None}
    assert {k: (r.turn_id, r.task_id, r.k, r.calls, r.unpriced, int(r.cost_p), r.context, r.cache_missed, r.ttl, r.expires_us) for k, r in got.items()} == want
    assert all(r.at_us == r.expires_us for r in out if r.kind == "expired") and len(want) > 150


@pytest.mark.parametrize("name", ["stream_session_state", "stream_corrections"])
def test_query_equals_the_batch_figures(spark, name):
    from callmeter.plans.oracle import SQL
    from callmeter.plans.queries import QUERIES
    from check import compare, duck
    ok, text = compare(spark, duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name, QUERIES[name], SQL[name])
    assert ok, text

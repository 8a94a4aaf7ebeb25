"""Late lines and results: the store equals the batch form, changes once, and is not moved by batches that run again."""

import random

from callmeter.session import scratch_path
from callmeter.streaming import corrections, live

S = 1_000_000
ROWS = ["session_key", "key", "t_us", "model", "output", "lines", "exact"]


def make(spark, rows):
    return spark.createDataFrame(rows, corrections.PIECES)


def store(spark, **kw):
    return corrections.CallStore(spark, scratch_path(spark, "store"), **kw)


def got(s):
    return sorted(tuple(r[c] for c in ROWS) for r in s.calls().collect())


def test_result_after_its_call_and_completed_line_change_a_call_once(spark):
    s = store(spark, delay_us=60 * S)
    s.apply(make(spark, [(1, 10, 1, 0, "a", 50, None), (1, 10, 2, 1 * S, "a", None, None), (1, 11, 1, 1000 * S, "b", 7, None), (2, 20, 1, 0, "c", None, None)]), 0)
    assert got(s) == [(1, 10, 0, "a", 50, 1, False), (1, 11, 1000 * S, "b", 7, 1, False)]
    s.apply(make(spark, [(1, 10, 2, 1 * S, "a", 80, None), (2, 20, 1, 0, "c", 5, None)]), 1)  # both lines whole now
    s.apply(make(spark, [(1, 10, None, 2 * S, None, None, 99), (1, 12, None, 5 * S, None, None, 3)]), 2)  # a result; one without its call
    s.apply(make(spark, [(1, 10, 2, 1 * S, "a", 80, None)]), 3)  # seen before: nothing
    assert got(s) == [(1, 10, 0, "a", 99, 2, True), (1, 11, 1000 * S, "b", 7, 1, False), (2, 20, 0, "c", 5, 1, False)]
    log = sorted((r.batch, r.key, r.op, r.output, r.late) for r in s.table("changes").collect())
    assert log == [(0, 10, "insert", 50, False), (0, 11, "insert", 7, False), (1, 10, "insert", 80, True), (1, 10, "retract", 50, True), (1, 20, "insert", 5, True),
                   (2, 10, "insert", 99, True), (2, 10, "retract", 80, True)]
    s.apply(make(spark, [(1, 12, 1, 5 * S, "d", 1, None)]), 4)  # the call of the early result
    assert (1, 12, 5 * S, "d", 3, 1, True) in got(s)


def pieces(seed, n=120):
    rng = random.Random(seed)
    out = []
    for key in range(n):
        session = 0 if rng.random() < 0.4 else rng.randrange(1, 9)
        for place in range(1, rng.randint(2, 5)):
            t = rng.randrange(10_000) * S
            out += [(session, key, place, t, rng.choice("abc"), rng.choice([None, rng.randrange(500)]), None) for _ in range(rng.randint(1, 2))]
        if rng.random() < 0.3:
            out.append((session, key, None, rng.randrange(10_000) * S, None, None, rng.randrange(900)))
    rng.shuffle(out)
    return out


def test_any_order_of_batches_and_replays_equal_the_batch_form(spark):
    rows = pieces(1)
    want = sorted(tuple(r[c] for c in ROWS) for r in corrections.calls_of(make(spark, rows)).collect())
    s = store(spark, delay_us=600 * S, buckets=4)
    parts = [rows[i::4] for i in range(4)]
    for n, part in enumerate(parts):
        s.apply(make(spark, part), n)
    first = sorted(map(tuple, s.table("changes").collect()), key=str)
    assert got(s) == want
    for n in (2, 3, 3):  # a batch that fails is run again with those after it
        s.apply(make(spark, parts[n]), n)
    assert got(s) == want and sorted(map(tuple, s.table("changes").collect()), key=str) == first
    net = {}
    for r in s.table("changes").collect():
        k = tuple(r[c] for c in ROWS)
        net[k] = net.get(k, 0) + (1 if r.op == "insert" else -1)
    assert sorted(k for k, v in net.items() if v) == want and set(net.values()) <= {0, 1}


def test_a_stream_of_files_and_a_restart(spark):
    rows, path = pieces(2, 60), scratch_path(spark, "files")
    s = store(spark)
    for part in (rows[:50], rows[50:90], rows[90:]):
        make(spark, part).coalesce(1).write.mode("append").parquet(path)
    corrections.correct(live.read_files(spark, path, make(spark, []).schema, files_per_trigger=1), s)
    assert got(s) == sorted(tuple(r[c] for c in ROWS) for r in corrections.calls_of(make(spark, rows)).collect())


def test_only_touched_calls_are_written(spark):
    s = store(spark)
    s.apply(make(spark, [(k % 3, k, 1, k * S, "a", k, None) for k in range(200)]), 0)
    s.apply(make(spark, [(5 % 3, 5, None, 0, None, None, 77)]), 1)
    assert sorted((r.key, r.op) for r in s.table("changes").filter("batch = 1").collect()) == [(5, "insert"), (5, "retract")]
    s.apply(make(spark, []), 2)
    assert s.table("changes").filter("batch = 2").count() == 0 and s.calls().count() == 200

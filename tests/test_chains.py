"""Walks up the parent links against a plain loop, over random graphs and long chains."""

import random

import pytest

from callmeter.operators import chains
from callmeter.session import scratch_path

NODES = "session_key long, uuid string, parent string, prompt_id string, kind string, chars long, t_us long, call string, result_ids array<string>, boundary boolean"


def plain(calls, nodes):
    by = {(n[0], n[1]): n for n in nodes}
    walks, hits = [], []
    for s, key, parent in calls:
        at, hops, has, chars, trigger, outcome, compacted = parent, 0, False, 0, None, None, None
        while at is not None and hops < 500 and (outcome is None or compacted is None):
            n = by.get((s, at))
            kind = n[4] if n else None
            walking = outcome is None
            if walking:
                if n is None or (kind == "assistant" and n[7] != key) or (kind == "prompt" and has):
                    outcome = "end"
                elif kind == "prompt":
                    outcome, chars, trigger = "prompt", chars + n[5], n[6]
                elif kind == "tool_result":
                    chars += n[5]
                    hits += [(s, key, i) for i in n[8]]
                    trigger = n[6] if trigger is None else trigger
                    has = has or bool(n[8])
                elif kind == "meta":
                    chars += n[5]
            if compacted is None:
                if n and n[9]:
                    compacted = True
                elif n is None or kind == "assistant" or hops + 1 >= 50:
                    compacted = False
            at, hops = (n[2] if n else None), hops + 1
        walks.append((s, key, has, chars, trigger, outcome, bool(compacted)))
    return sorted(walks, key=str), sorted(hits)


def run(spark, calls, nodes):
    c = spark.createDataFrame(calls, "session_key long, key string, parent string")
    walk, hits = chains.trigger_walk(c, spark.createDataFrame(nodes, NODES).drop("prompt_id"))
    names = ("session_key", "key", "has_ids", "chars", "trigger_us", "outcome", "after_compaction")
    return sorted((tuple(r[n] for n in names) for r in walk.collect()), key=str), sorted(map(tuple, hits.select("session_key", "key", "tool_use_id").collect()))


def test_random_graphs(spark):
    rng = random.Random(8)
    nodes, calls = [], []
    for s in range(3):
        for i in range(300):
            kind = rng.choice(["prompt", "assistant", "tool_result", "tool_result", "meta", "other", "other", "other"])
            parent = None if rng.random() < 0.03 else "gone" if rng.random() < 0.03 else f"u{max(0, i - rng.randint(1, 2))}" if i else None
            nodes.append((s, f"u{i}", parent, None, kind, rng.randint(0, 50), rng.choice([None, i]), f"c{i // 3}" if kind == "assistant" else None,
                          [f"r{i}_{j}" for j in range(rng.randint(0, 2))] if kind == "tool_result" else [], kind == "other" and rng.random() < 0.05))
            calls += [(s, f"c{i}", f"u{i}")] if rng.random() < 0.5 else []
        calls += [(s, "x", None), (s, "y", "gone")]
    assert run(spark, calls, nodes) == plain(calls, nodes)


def test_long_chains_and_their_ends(spark, monkeypatch):
    cuts = []
    keep = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: cuts.append(1) or keep(df))
    nodes, calls = [], []
    for s, n in enumerate((1, 49, 50, 51, 498, 499, 500, 501, 700)):
        nodes.append((s, "n0", None, None, "prompt", 5, 1, None, [], n in (50, 51)))
        nodes += [(s, f"n{i}", f"n{i - 1}", None, "meta" if i % 3 else "tool_result", 1, i, None, [f"t{i}"] if i % 99 == 0 else [], i % 60 == 10) for i in range(1, n)]
        calls += [(s, "a", f"n{n - 1}"), (s, "b", f"n{n // 2}")]
    assert run(spark, calls, nodes) == plain(calls, nodes)
    assert len(cuts) <= 20  # nine levels and a climb for walks, six and a climb for compactions


def test_lines_of_the_call_itself_are_passed(spark):
    nodes = [(1, "p", None, None, "prompt", 7, 1, None, [], False), (1, "a1", "p", None, "assistant", 0, 2, "c", [], False), (1, "a2", "a1", None, "assistant", 0, 3, "c", [], False),
             (1, "r", "a2", None, "tool_result", 2, 4, None, [], False), (1, "a3", "r", None, "assistant", 0, 5, "c", [], False), (1, "d", "p", None, "assistant", 0, 5, "d", [], False)]
    calls = [(1, "c", "a3"), (1, "e", "a3"), (1, "d", "d")]
    assert run(spark, calls, nodes) == plain(calls, nodes)


def test_tasks_come_down_the_launches_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rounds.append(1) or keep(df))
    calls = [(1, "k0", "main", "task")] + [(1, f"k{i}", f"t{i}", None) for i in range(1, 65)] + [(1, "lost", "t99", None), (1, "o1", "ring1", None), (1, "o2", "ring2", None)]
    launches = [(1, f"t{i}", f"k{i - 1}") for i in range(1, 65)] + [(1, "ring1", "o2"), (1, "ring2", "o1")]
    out = chains.launched_tasks(spark.createDataFrame(calls, "session_key long, key string, thread string, task_id string"),
                                spark.createDataFrame(launches, "session_key long, thread string, launch_key string"))
    got = {r.key: r.task_id for r in out.collect()}
    assert all(got[f"k{i}"] == "task" for i in range(65)) and {got["lost"], got["o1"], got["o2"]} == {None} and len(rounds) <= 9


@pytest.mark.parametrize("walk", ["nearest_prompt", "trigger_walk", "launched_tasks"])
def test_no_side_of_a_walk_goes_through_the_driver(spark, monkeypatch, walk):
    """a cut table is taken for a part of the small file it came from, however many lines were made of it."""
    path, plans, real = scratch_path(spark, "nodes"), [], chains.cut
    rows = [(1, f"u{i}", f"u{i - 1}" if i else None, "p" if i % 40 == 0 else None, "prompt" if i % 40 == 0 else "tool_result", 1, i, None, [], False) for i in range(200)]
    spark.createDataFrame(rows, NODES).write.parquet(path)
    nodes = spark.read.parquet(path)
    monkeypatch.setattr(chains, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    if walk == "nearest_prompt":
        assert {r.root_prompt for r in chains.nearest_prompt(nodes).collect()} == {"p"}
    elif walk == "trigger_walk":
        found, _ = chains.trigger_walk(nodes.selectExpr("session_key", "concat('c', uuid) AS key", "uuid AS parent"), nodes.drop("prompt_id"))
        chains.cut(found)
        assert found.filter("outcome = 'prompt'").count() == 200
    else:  # u1 is launched by u0, u2 by u1, and so on
        calls = nodes.selectExpr("session_key", "uuid AS key", "uuid AS thread", "CASE WHEN parent IS NULL THEN 7 END AS task_id")
        found = chains.launched_tasks(calls, nodes.filter("parent IS NOT NULL").selectExpr("session_key", "uuid AS thread", "parent AS launch_key"))
        assert found.filter("task_id = 7").count() == 200
        plans = plans[1:]  # the launches themselves are few
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)

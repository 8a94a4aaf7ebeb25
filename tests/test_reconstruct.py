"""Logs to calls, over the small sessions in fixtures/logs: a split call, agents that launch agents, a damaged log."""

import os

import pytest

from callmeter.operators import reconstruct
from callmeter.sources import transcripts

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures", "logs")


@pytest.fixture(scope="module")
def tables(spark):
    return reconstruct.reconstruct(transcripts.read_lines(spark, ROOT), transcripts.read_sidecars(spark, ROOT))


@pytest.fixture(scope="module")
def sessions(tables):
    out = {}
    for r in tables.calls.collect():
        out.setdefault(r["session_id"], []).append(r)
    return {s: sorted(rows, key=lambda r: r["t_us"]) for s, rows in out.items()}


def test_a_call_split_over_lines_counts_once_with_its_largest_output(sessions):
    read, answer = sessions["tide"]
    assert (read["input_new"], read["cache_read"], read["cache_write"], read["input_total"]) == (7, 640, 310, 957)
    assert (read["output"], read["lines"], read["trigger"]) == (90, 2, "user_turn")
    assert (answer["output"], answer["lines"], answer["trigger"]) == (21, 1, "tool_call")
    assert read["task_id"] == answer["task_id"] == "tide-p1"
    assert [read["added_chars"], answer["added_chars"]] == [len("count the crates"), len("rows: 12")]


def test_text_counts_however_deep_it_lies(tables, sessions):
    assert [r["added_chars"] for r in sessions["nest"]] == [len("six down") + len("top"), len("eleven")]
    assert [r["prompt_chars"] for r in tables.tasks.filter("task_id = 'nest-p1'").collect()] == [len("six down") + len("top")]


def test_agents_launched_by_agents_belong_to_the_prompt_five_launches_up(sessions):
    assert len(sessions["deep"]) == 6
    assert {r["task_id"] for r in sessions["deep"]} == {"deep-p1"}
    assert [r["trigger"] for r in sessions["deep"]].count("subagent") == 5


def test_damaged_lines_are_counted_by_reason(tables, sessions):
    assert [r["input_total"] for r in sessions["wreck"]] == [6]
    got = {(r["bucket"], r["reason"]): r["n"] for r in tables.outcomes.filter("session_key LIKE '%wreck'").collect()}
    assert {k: n for k, n in got.items() if k[0] != "used"} == {
        ("unreadable", "bad_json"): 1, ("unreadable", "not_an_object"): 1, ("unreadable", "no_type"): 1, ("unreadable", "assistant_bad_usage"): 1,
        ("unknown_type", "buoy"): 2, ("unknown_with_tokens", "buoy"): 1}


def test_calls_keep_the_contract(tables):
    assert reconstruct.contract_violations(tables.calls).isEmpty()


def test_the_owner_of_a_call_is_the_first_project_even_where_names_begin_alike(spark):
    rows = spark.createDataFrame([("t1", "log:shop-web/a"), ("t1", "log:shop/z"), ("t1", "log:shop/y")], "turn_id string, session_key string")
    assert [r["session_key"] for r in reconstruct.first_owner(rows, ["turn_id"]).collect()] == ["log:shop/y"]

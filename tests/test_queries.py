"""Registered queries against their SQL oracles on the smallest data; `tests/check.py` runs the rest at any scale."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
from callmeter.plans.oracle import SQL

NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, con, name):
    ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_keeps_all_four_consumers(spark):
    rows = entry.entry(spark).collect()
    assert {r["category"] for r in rows} == {"subagents", "reviews", "tool_turns", "user_turns"}
    assert abs(sum(r["token_share"] for r in rows) - 100) < 0.3


@pytest.mark.parametrize("name", ["cache_events", "counter_checks", "task_ranks", "leak_free_by_slice", "other_session_active", "settle_estimates", "turns_ahead", "suffix_match"])
def test_hot_groups_give_the_same_result(spark, con, name):
    """Every ordered group is over the limit, so all of them are cut into slices."""
    spark.conf.set("spark.callmeter.group.maxRows", "60")
    try:
        ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    finally:
        spark.conf.unset("spark.callmeter.group.maxRows")
    assert ok, text

"""Live state of sessions: what each call says about its session, and a row when its cached prefix ends without a further call."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callmeter.functions.labels import MIN_CACHEABLE
from callmeter.operators.cache import DEFAULT_TTL, SECOND_US
from callmeter.streaming.live import BUCKETS, NO_SESSION

c = F.col
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 24 * 3600 * SECOND_US
OUTPUT = ("session_key long, kind string, at_us long, turn_id long, task_id long, k long, calls long, unpriced long, cost_p decimal(38,0), context long, "
          "cache_missed boolean, ttl long, expires_us long")
#: The two newest main calls, the newest lifetime written, sums over all calls (money in three parts of 13 digits), and when the session wakes.
CALL = ("t_us", "turn_id", "input_total", "output", "cache_read", "task_id")
NAMES = ["session_key", *(f"{n}_{k}" for n in ("last", "prev") for k in CALL), "ttl_t", "ttl_turn", "ttl", "calls", "unpriced", "cost_0", "cost_1", "cost_2", "due_ms"]
AT = {n: i for i, n in enumerate(NAMES)}
LAST, PREV = (slice(AT[f"{n}_t_us"], AT[f"{n}_task_id"] + 1) for n in ("last", "prev"))
COST = slice(AT["cost_0"], AT["cost_2"] + 1)
COLUMNS = ["session_key", *CALL, "cache_write", "cache_write_1h"]
BEFORE, LIMB = -(2**63), 10**13
#: A bucket's sessions, a row each by session; turns and last move of their tasks by (session, task); when the bucket's timer is due.
STATE = "heads binary, turns binary, timer_ms long"


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changes = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        changes |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(np.ones(min(len(keys[0]), 1), bool), changes))


def _end(heads: np.ndarray, second_us: int) -> np.ndarray:
    return heads[:, AT["last_t_us"]] + heads[:, AT["ttl"]] * second_us


def _newest(place: np.ndarray, t_us: np.ndarray, turn_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by place, then newest first and what came first of equals, and where places begin in it."""
    order = np.lexsort((np.arange(len(place)), ~turn_id, ~t_us, place))
    return order, _begins(place[order])


class Sessions(StatefulProcessor):
    """State of a bucket of sessions. Everything kept of a session is a sum or the newest by (t_us, turn_id), so calls may come in any order.

    Each session has a time to wake of its own; the bucket's one timer is set to the first of them.
    """

    def __init__(self, forget_us: int, second_us: int, event_time: bool) -> None:
        self.forget_us, self.second_us, self.event_time = forget_us, second_us, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", STATE)

    def _read(self) -> tuple[np.ndarray, np.ndarray, int]:
        heads, turns, timer_ms = self.state.get() or (b"", b"", -1)
        return np.frombuffer(heads, np.int64).reshape(-1, len(NAMES)).copy(), np.frombuffer(turns, np.int64).reshape(-1, 4).copy(), timer_ms

    def _write(self, heads: np.ndarray, turns: np.ndarray, timer_ms: int) -> None:
        """Keeps the state and one timer, for the session that wakes first."""
        due = int(heads[:, AT["due_ms"]].min()) if len(heads) else -1
        if due != timer_ms:
            if timer_ms >= 0:
                self.handle.deleteTimer(timer_ms)
            if len(heads):
                self.handle.registerTimer(due)
        if len(heads):
            self.state.update((heads.tobytes(), turns.tobytes(), due))
        else:
            self.state.clear()

    def _rows(self, key: tuple, s: np.ndarray, turns: np.ndarray, kind: str, at_us: np.ndarray) -> pd.DataFrame:
        of = {n: s[:, i] for n, i in AT.items()}
        none, pair = of["last_t_us"] == BEFORE, of["prev_t_us"] != BEFORE
        missed = pair & (of["prev_input_total"] >= MIN_CACHEABLE) & (2 * of["last_cache_read"] < of["prev_input_total"]) & (of["prev_input_total"] <= 2 * of["last_input_total"])
        running = pd.MultiIndex.from_arrays([of["session_key"], of["last_task_id"]])
        at = pd.MultiIndex.from_arrays([turns[:, 0], turns[:, 1]]).get_indexer(running)
        some = lambda x, without=none: pd.arrays.IntegerArray(x.copy(), without.copy())
        k = turns[at, 2] if len(turns) else np.zeros(len(s), np.int64)
        return pd.DataFrame({
            "session_key": some(of["session_key"], np.full(len(s), key[0] == NO_SESSION)), "kind": kind, "at_us": at_us, "turn_id": some(of["last_turn_id"]),
            "task_id": some(of["last_task_id"]), "k": some(k, none | (at < 0)), "calls": of["calls"], "unpriced": of["unpriced"],
            "cost_p": [Decimal(a + LIMB * (b + LIMB * x)) for a, b, x in s[:, COST].tolist()], "context": some(of["last_input_total"] + of["last_output"]),
            "cache_missed": missed, "ttl": of["ttl"], "expires_us": some(np.where(none, 0, _end(s, self.second_us)))})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads, turns, timer_ms = self._read()
        new = pd.concat(list(rows), ignore_index=True)
        cells = new[COLUMNS].to_numpy(np.int64)
        keys, place = np.unique(cells[:, 0], return_inverse=True)
        begun = np.zeros((len(fresh := np.setdiff1d(keys, heads[:, 0])), len(NAMES)), np.int64)
        begun[:, AT["session_key"]] = fresh
        begun[:, [AT["last_t_us"], AT["prev_t_us"], AT["ttl_t"]]] = BEFORE
        begun[:, AT["ttl"]], begun[:, AT["due_ms"]] = DEFAULT_TTL, -1
        heads = np.concatenate([heads, begun])
        heads = heads[np.argsort(heads[:, 0])]
        mine = np.searchsorted(heads[:, 0], keys)
        s = heads[mine]

        money = [None if pd.isna(x) else int(x) for x in new["cost_p"]]
        unpriced = np.array([x is None for x in money], bool)
        s[:, AT["calls"]] += np.bincount(place, minlength=len(keys))
        s[:, AT["unpriced"]] += np.bincount(place[unpriced], minlength=len(keys))
        order = np.argsort(place, kind="stable")
        added = np.add.reduceat(np.array([x or 0 for x in money], object)[order], _begins(place[order]))
        for i, x in enumerate(added):
            total = int(x) + sum(int(n) * LIMB**j for j, n in enumerate(s[i, COST]))
            s[i, COST] = total % LIMB, total // LIMB % LIMB, total // LIMB**2

        main = new["main"].to_numpy(bool)
        calls, at = cells[main][:, 1:], place[main]
        # the two newest of what was known and what is new; of equal ones what came first
        known = [(x, np.flatnonzero(s[:, x.start] != BEFORE)) for x in (LAST, PREV)]
        both = np.concatenate([*(s[i, x] for x, i in known), calls[:, :len(CALL)]])
        whose = np.concatenate([*(i for _, i in known), at])
        order, first = _newest(whose, both[:, 0], both[:, 1])
        s[whose[order[first]], LAST] = both[order[first]]
        second = np.setdiff1d(first + 1, np.append(first, len(order)))
        s[whose[order[second]], PREV] = both[order[second]]
        wrote = np.flatnonzero(calls[:, len(CALL)] > 0)
        order, first = _newest(at[wrote], calls[wrote, 0], calls[wrote, 1])
        best = wrote[order[first]]
        (t, turn, one_hour), i = calls[best][:, [0, 1, len(CALL) + 1]].T, at[best]
        later = (t > s[i, AT["ttl_t"]]) | (t == s[i, AT["ttl_t"]]) & (turn > s[i, AT["ttl_turn"]])
        s[i[later], AT["ttl_t"]], s[i[later], AT["ttl_turn"]] = t[later], turn[later]
        s[i[later], AT["ttl"]] = np.where(one_hour[later] > 0, 3600, 300)

        # turns per task and when it last moved; tasks that a session has left long ago go
        each = np.concatenate([turns, np.column_stack([keys[at], calls[:, 5], np.ones(len(at), np.int64), calls[:, 0]])])
        each = each[np.lexsort((each[:, 1], each[:, 0]))]
        if len(each):
            begin = _begins(each[:, 0], each[:, 1])
            each = np.column_stack([each[begin, :2], np.add.reduceat(each[:, 2], begin), np.maximum.reduceat(each[:, 3], begin)])
        heads[mine] = s
        newest = heads[np.searchsorted(heads[:, 0], each[:, 0]), AT["last_t_us"]]
        turns = each[~(each[:, 3] + self.forget_us < newest)]

        seen = np.zeros(len(keys), np.int64)
        np.maximum.at(seen, place, cells[:, 1])
        wake_us = np.where(s[:, AT["last_t_us"]] != BEFORE, _end(s, self.second_us), seen + self.forget_us)
        heads[mine, AT["due_ms"]] = -(-wake_us // 1000)
        yield self._rows(key, s, turns, "call", seen)
        self._write(heads, turns, timer_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        heads, turns, _ = self._read()
        now_ms = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        due_ms = heads[:, AT["due_ms"]]
        woken = (due_ms < now_ms) | (due_ms <= expiredTimerInfo.getExpiryTimeInMs())
        now_us, last = due_ms * 1000, heads[:, AT["last_t_us"]]
        none = last == BEFORE
        gone = woken & (none | (now_us >= np.where(none, 0, last) + self.forget_us))
        ended = woken & ~gone & (now_us >= np.where(none, 0, _end(heads, self.second_us)))
        if ended.any():
            yield self._rows(key, heads[ended], turns, "expired", _end(heads[ended], self.second_us))
        wake_us = np.maximum(np.where(none, 0, last) + self.forget_us, now_us + 1000)
        heads[:, AT["due_ms"]] = np.where(woken, -(-wake_us // 1000), due_ms)
        self._write(heads[~gone], turns[~np.isin(turns[:, 0], heads[gone, 0])], -1)  # the timer is spent

    def close(self) -> None:
        pass


def live_sessions(calls: DataFrame, delay: str | None = None, forget_us: int = 30 * DAY_US, second_us: int = SECOND_US, buckets: int = BUCKETS) -> DataFrame:
    """A row per session and trigger with calls (`kind` call), and one when its lifetime in force ends without a further main call (`expired`).

    k is the number of turns of the task of the newest main call. cost_p, calls and unpriced add up all calls; cache_missed and
    context are those of the newest main call, whatever the order of arrival. State goes forget_us after the newest main call.

    Without `delay` the clock is the machine's, for sessions that are going on; with it, the watermark of t_us with that delay is, for logs
    that are replayed. The stream needs a state store with timers, which this sets for the session. The sessions of a bucket share a row of the
    state store and a timer, and are worked off together; a stream keeps its number of buckets for life.
    """
    spark = calls.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    numbers = [F.coalesce(c(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in COLUMNS]
    bucket = F.when(c("session_key").isNull(), NO_SESSION).otherwise(F.pmod(F.xxhash64("session_key"), F.lit(buckets))).alias("bucket")
    rows = calls.withColumn("ts", F.timestamp_micros("t_us"))
    rows = rows if delay is None else rows.withWatermark("ts", delay)
    rows = rows.select(bucket, "ts", *numbers, c("cost_p").cast("decimal(38,0)").alias("cost_p"), F.coalesce(c("trigger") != "subagent", F.lit(False)).alias("main"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        Sessions(forget_us, second_us, delay is not None), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if delay is None else "EventTime")

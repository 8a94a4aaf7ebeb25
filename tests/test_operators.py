"""Operators against brute force and against figures worked out by hand."""

import hashlib
import math
import random
import zlib
from datetime import date, datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmeter.functions import labels, periods, text
from callmeter.operators import backtest, forecast, neighbours, quantiles, reconcile, scores, settle, signs, textscan, tree
from callmeter.operators.ordered import SLICE, last_seen, next_seen, running_sum, scan, with_slices
from callmeter.sources import prices

MINUTE = 60_000_000


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows; values repeat and some are missing."""
    rnd = random.Random(5)
    rows = [("hot" if i % 4 else f"k{i % 3}", i * 7_000_000, i, None if i % 11 == 0 else rnd.randint(0, 9)) for i in range(900)]
    return spark.createDataFrame(rows, "k string, t_us long, id long, v int").cache()


def test_slices_change_nothing(hot):
    specs = dict(s=running_sum(F.coalesce("v", F.lit(0))), before=last_seen(F.col("v")), at=last_seen(F.col("v"), inclusive=True),
                 after=next_seen(F.col("v")), n=running_sum(F.lit(1), inclusive=False))
    cut = with_slices(hot, ["k"], "t_us", limit=50)
    assert SLICE in cut.columns and SLICE not in with_slices(hot, ["k"], "t_us").columns
    assert cut.groupBy("k", SLICE).count().agg(F.max("count")).first()[0] <= 60
    plain = scan(hot, ["k"], ["t_us", "id"], **specs)
    sliced = scan(cut, ["k"], ["t_us", "id"], **specs).drop(SLICE).select(plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


@pytest.mark.parametrize("whole,limit", [(True, 10_000), (True, 60), (False, 60)])
def test_expanding_quantiles_see_only_earlier_rows(spark, whole, limit):
    rnd = random.Random(1)
    # real values: a third are one and the same, the rest spread over decades
    ys = [rnd.randint(1, 30) if whole else (0.25 if i % 3 == 0 else round(math.exp(rnd.gauss(0, 3)), 6)) for i in range(240)]
    df = spark.createDataFrame([(i * MINUTE, i, y) for i, y in enumerate(map(float, ys))], "started_us long, task_id long, y double")
    out = quantiles.expanding_quantiles(df, "y", ["started_us", "task_id"], {"lo": 0.1, "mid": 0.5, "hi": 0.9}, None, whole, limit=limit)
    rows = {r["task_id"]: r for r in out.collect()}
    assert len(rows) == len(ys)
    for i in range(1, len(ys)):
        want = np.percentile(ys[:i], [10, 50, 90])
        assert rows[i]["n_before"] == i
        assert np.allclose([rows[i]["lo"], rows[i]["mid"], rows[i]["hi"]], want), i


def test_exact_percentiles_by_bins(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.gauss(0, 5) if i % 2 else 1.5) for g in ("a", "b") for i in range(501)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in quantiles.exact_percentiles(df, ["g"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in ("a", "b"):
        assert np.allclose([got[g]["p10"], got[g]["p50"], got[g]["p99"]], np.percentile([x for k, x in rows if k == g], [10, 50, 99]))


def test_interval_score_by_hand(spark):
    df = spark.createDataFrame([(2.0, 5.0, 10.0), (2.0, 1.0, 10.0), (2.0, 13.0, 10.0)], "lo double, y double, hi double")
    got = [round(r[0], 6) for r in df.select(scores.interval_score(F.col("lo"), F.col("y"), F.col("hi"))).collect()]
    assert got == [8, 18, 38]


def plain_weights(session):
    out = []
    for i in range(400):
        h = int(hashlib.md5(f"{i // 4}:{session}".encode()).hexdigest()[8 * (i % 4):8 * (i % 4) + 8], 16)
        k, cdf = 0, math.exp(-1)
        while h >= int(2**32 * cdf) and k < 12:
            k += 1
            cdf = sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))
        out.append(k)
    return out


def test_bootstrap_against_resampled_lists(spark):
    rnd = random.Random(6)
    rows = [(g, s, rnd.choice([0.0, 1.0]), rnd.choice([None, *range(9)]) if s % 3 else float(s)) for g in "ab" for s in range(12) for _ in range(rnd.randint(1, 9))]
    rows += [("c", 1, 1.0, 2.0), ("c", 1, 0.0, 3.0), ("d", 1, 1.0, 0.5), ("d", 2, 0.0, None)]
    rows = [(g, s, x, None if y is None else float(y)) for g, s, x, y in rows]
    items = spark.createDataFrame(rows, "g string, session_key long, coverage double, width double")
    got = {r["g"]: r for r in scores.bootstrap(items, ["g"], means=("coverage",), medians=("width",)).collect()}
    assert set(got) == {"a", "b", "d"}  # one session is no sample
    w = {s: plain_weights(s) for s in range(13)}
    for g in got:
        means, medians = [], []
        for i in range(400):
            picked = [(x, y) for k, s, x, y in rows if k == g for _ in range(w[s][i])]
            means += [sum(x for x, _ in picked) / len(picked)] if picked else []
            values = sorted(y for _, y in picked if y is not None)
            medians += [float(np.median(values))] if values else []
        for name, found in (("coverage", means), ("width", medians)):
            found.sort()
            for end, q in (("lo", 0.025), ("hi", 0.975)):
                assert abs(got[g][f"{name}_{end}"] - found[int(q * (len(found) - 1) + 1e-9)]) < 1e-6, (g, name, end)
    assert abs(sum(map(sum, w.values())) / (13 * 400) - 1) < 0.05  # each session once on average


def test_gap_shapes(spark):
    series = {"unknown": [(3, -100)], "too few intervals": [(3, -5), (6, -9)], "none": [(3, 0), (6, 0)],
              "concentrated": [(3, 0), (6, -9000), (9, -9000), (12, -9000)], "spread": [(3, -10), (6, -20), (9, -30), (12, -40)],
              "concentrated2": [(3, -1), (6, -2), (9, -1000), (12, -1003)]}
    calls, snaps = [], []
    for name, points in series.items():
        at, gap0 = 0, 0
        for n, gap in points:
            for _ in range(n - at):
                at += 1
                calls.append((name, at * 2, 10, 0, 0, 5))
            snaps.append((name, at * 2 + 1, "m", 10 * at - gap, 0, 0, 5 * at))
    c = spark.createDataFrame(calls, "session_key string, line long, input_new long, cache_read long, cache_write long, output long")
    s = spark.createDataFrame(snaps, "session_key string, line long, model string, c_input long, c_read long, c_write long, c_output long")
    got = {r["session_key"]: r["kind"] for r in reconcile.gap_shape(reconcile.series(c, s)).collect()}
    assert got == {k: k.rstrip("2") for k in series}


def test_verified_needs_every_model_on_both_sides(spark):
    base = {s: 0 for s in reconcile.STATUSES}
    for one_sided, want in ((0, "verified"), (1, "partly verified")):
        status = spark.createDataFrame([("a", "exact", one_sided, 0)], "session_key string, status string, models_counter_only long, models_lines_only long")
        assert reconcile.summary(status, 1).first()["verdict"] == want
    assert base


def test_settling_scenarios(spark):
    s = 1_000_000
    tasks = spark.createDataFrame([("a", 1, 100 * s, 200 * s, 5, True), ("a", 2, 4000 * s, 4100 * s, 2, True), ("b", 3, 50 * s, 60 * s, 1, True)],
                                  "session_key string, task_id long, started_us long, last_us long, turns_main long, tracked boolean")
    est = spark.createDataFrame([(1, "a", 90 * s), (2, "a", 95 * s), (3, "a", 103 * s), (4, "a", 200 * s), (5, "b", 70 * s), (6, "b", 9000 * s)],
                                "est_id long, session_key string, made_us long")
    got = {r["est_id"]: r for r in settle.settle(est, tasks, 9100 * s).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        1: "superseded", 2: "superseded", 3: "linked", 4: "unmatched", 5: "unmatched", 6: "open"}
    assert got[3]["task_id"] == 1 and got[3]["finished"]


def test_followups_fold_into_the_task_before(spark):
    rows = [("s", i, i * MINUTE, t, t, t * 10, f) for i, (t, f) in enumerate([(3, True), (2, True), (7, False), (1, True), (4, False)])]
    df = spark.createDataFrame(rows, "session_key string, task_id long, started_us long, turns_main long, turns long, cost_p long, followup boolean")
    got = sorted((r["task_id"], r["turns_main"]) for r in signs.merge_followups(df).collect())
    assert got == [(0, 5), (2, 8), (4, 4)]


@pytest.mark.parametrize("window", [1, 7, 512])
def test_nearest_prompts_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(neighbours, "WINDOW", window)
    rnd = random.Random(3)
    vocab = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    vocab = [w.replace("w", "wor") for w in vocab]
    docs = [(i, " ".join(rnd.choices(vocab, weights=[1 / (j + 1) for j in range(len(vocab))], k=6))) for i in range(160)]
    rows = [(i, w, float(1 + (zlib.crc32(w.encode()) % 5))) for i, t in docs for w in sorted(set(t.split()))]
    vec = {}
    for i, w, x in rows:
        vec.setdefault(i, {})[w] = x
    unit = {i: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for i, v in vec.items()}
    df = spark.createDataFrame([(i, i, w, unit[i][w]) for i, w, _ in rows], "id long, o long, word string, w double")
    got = {}
    for r in neighbours.top_similar(df, "id", "o", k=4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["near_id"]))
    for i in unit:
        sims = [(round(sum(x * unit[j].get(w, 0) for w, x in unit[i].items()), 9), j) for j in range(i)]
        want = [j for _, j in sorted([x for x in sims if x[0] >= 0.1], reverse=True)[:4]]
        assert [j for _, j in sorted(got.get(i, []))] == want, i


def test_no_prompt_reads_further_for_the_number_of_its_window(spark, monkeypatch):
    """Two like prompts stand within two windows of each, so three rounds do for all 51 windows, also for those of a round number."""
    rounds, real = [], neighbours.cut
    monkeypatch.setattr(neighbours, "WINDOW", 8)
    monkeypatch.setattr(neighbours, "cut", lambda df: rounds.append(1) or real(df))
    rows = [(i, 10 * i, f"a{i % 3}", 1.0) for i in range(408)]
    got = neighbours.top_similar(spark.createDataFrame(rows, "id long, o long, word string, w double"), "id", "o", k=2)
    assert got.count() == 2 * 408 - 3 * 3 and len(rounds) <= 2 + 2 * 3


def test_equal_prompts_go_to_the_latest_and_new_words_have_none(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 8)
    rows = [(i, 10 * i, w, 0.5**0.5) for i in range(400) for w in (f"a{i % 3}", f"b{i % 3}")] + [(999, 3995, "new", 1.0)]
    got = neighbours.top_similar(spark.createDataFrame(rows, "id long, o long, word string, w double"), "id", "o", k=2)
    assert {(r.id, r.near_id, r.rank) for r in got.collect()} == {(i, i - 3 * k, k) for i in range(400) for k in (1, 2) if i >= 3 * k}


@pytest.mark.parametrize("window, cells, few", [(16, 50, 0), (400, 10**6, 10**6)])
def test_lists_of_the_nearest_leave_a_task_and_no_pairs(spark, monkeypatch, window, cells, few):
    """prompts of one time, repeated rows, words that all share, prompts that no earlier one is like; a row a prompt whatever its pairs."""
    for name, x in (("WINDOW", window), ("CELLS", cells), ("FEW", few)):
        monkeypatch.setattr(neighbours, name, x)
    rng, rows = random.Random(9), []
    for i in range(150):
        held = ["every", *rng.sample("abcdefghijkl", rng.randint(1, 4))] if i % 11 else [f"own{i}"]
        rows += [(i, i // 2, w, x / len(held) ** 0.5) for w in held for x in ((1.0,) if i % 7 else (0.5, 0.5))]  # now and then in two rows
    plans, stored = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, label: plans.append(df._jdf.queryExecution().analyzed().toString()) or stored(df, label))
    df = spark.createDataFrame([*rows, (None, 3, "a", 1.0), (900, None, "a", 1.0)], "id long, o long, word string, w double")
    got = {r.id: [(n.sim, n.near_order, n.near_id) for n in r.best] for r in neighbours.top_lists(df, "id", "o", k=3).collect()}
    vec = {}
    for i, _, w, x in rows:
        vec.setdefault(i, {})[w] = vec.get(i, {}).get(w, 0) + x
    for i in range(150):
        sims = [(round(sum(x * vec[j].get(w, 0) for w, x in vec[i].items()), 9), j // 2, j) for j in range(150) if j // 2 < i // 2]
        want = sorted([x for x in sims if x[0] >= 0.1], reverse=True)[:3]
        assert [x[:2] for x in got.pop(i, [])] == [x[:2] for x in want], i
    assert not got and "near_id" not in plans[0] and not any("word" in line and "Join" in line for p in plans for line in p.splitlines())


def test_neighbours_are_read_once_and_not_written_as_rows(spark, monkeypatch):
    """thirty rows a prompt, so they go straight to the figures of their prompt; some neighbours are no known task."""
    written, real = [], forecast.cut
    monkeypatch.setattr(forecast, "cut", lambda df: written.append(df.columns) or real(df))
    tasks = spark.createDataFrame([(1, t, t, 1 + t % 5, 2 + t % 5, "question") for t in range(40)], "session_key long, task_id long, started_us long, turns_main long, turns long, family string")
    asked = spark.createDataFrame([(p, 1, None, (t,)) for p, t in ((100, 3), (101, 3), (102, 3))], "prompt_id long, session_key long, family string, last struct<task_id: long>")
    near = spark.createDataFrame([(100, t) for t in (4, 9, 14, 19, 900)] + [(101, 900)], "prompt_id long, near_id long")
    got = {r.prompt_id: r for r in forecast.choose_basis(asked, tasks, near).collect()}
    assert [(got[p].basis, got[p].samples, got[p].p50, got[p].all_p50, got[p].max_turns) for p in (100, 101)] == [("neighbours", 4, 5.0, 6.0, 5), ("neighbours", None, None, None, None)]
    assert got[102].basis != "neighbours" and not any("near_id" in columns for columns in written)


@pytest.mark.parametrize("window", [8, 512])
def test_tasks_with_enough_neighbours_besides_the_running_one(spark, monkeypatch, window):
    monkeypatch.setattr(neighbours, "WINDOW", window)
    said = spark.createDataFrame([(i, 10 * i, f"alpha{chr(97 + i % 25)} beta{chr(97 + i % 25)}") for i in range(100)], "task_id long, started_us long, text string")
    asked = spark.createDataFrame([(i, (i - 25,)) for i in range(100)], "prompt_id long, last struct<task_id: long>")
    got = {}
    for r in forecast.nearest_tasks(asked, said, k=2).collect():
        got.setdefault(r.prompt_id, set()).add(r.near_id)
    assert got == {i: {i - 50, i - 75} for i in range(75, 100)}


def test_history_neighbours_count_the_query(spark):
    hist = spark.createDataFrame([(i, f"migrate ledger schema batch{i}" if i < 3 else f"alpha{chr(97 + i % 26)} beta{chr(97 + i // 26)}x")
                                  for i in range(80)], "id long, text string")
    q = spark.createDataFrame([(1000, "migrate the ledger now")], "id long, text string")
    got = neighbours.nearest_in_history(q, hist, "id", "text", k=3)
    assert [r["near_id"] for r in got.orderBy("rank").collect()] == [2, 1, 0]
    assert neighbours.nearest_in_history(q, hist, "id", "text", k=4).isEmpty()


def test_prices(spark):
    table = prices.from_config({"models": {"m-1": {"input": 4, "output": 20, "cache_read": 0.2}}, "verified_on": "2026-01-01"})
    df = spark.createDataFrame([("m-1",), ("m-1-20260101",), ("m-12",)], "model string")
    got = {r["model"]: r["price_key"] for r in prices.with_prices(df, table).collect()}
    assert got == {"m-1": "m-1", "m-1-20260101": "m-1", "m-12": None}
    assert {r["model"]: r["price_key"] for r in prices.with_prices(df, table.frame(spark)).collect()} == got
    assert table.staleness(spark, date(2026, 2, 1)).first()["stale"] is False
    assert table.staleness(spark, date(2026, 6, 1)).first()["stale"] is True
    with pytest.raises(prices.PriceError, match="cache_read"):
        prices.from_config({"models": {"m": {"input": 1, "output": 2}}})


def test_small_functions(spark):
    now = datetime(2026, 9, 8, tzinfo=timezone.utc)
    assert periods.since_us("7d", now) == periods.since_us("2026-09-01")
    one = spark.range(1)
    pick = lambda x: one.select(x).first()[0]
    assert [pick(labels.project_name(F.lit(p))) for p in (r"C:\work\shop", "/srv/demo/shop/", "/")] == ["shop", "shop", "/"]
    assert pick(labels.normal_model(F.lit("m-5[1m]"))) == "m-5"
    assert pick(labels.newer_than(F.lit("2.1.300"), "2.1.288")) and not pick(labels.newer_than(F.lit("2.1.9"), "2.1.288"))
    assert pick(labels.is_prefix_file(F.lit(r"a\.claude\x.json"))) and not pick(labels.is_prefix_file(F.lit("src/app.py")))
    for said, family in (("relis le module", "review"), ("refactor the cart", "refactor"), ("how fast is it?", "measure"),
                         ("what is this?", "question"), ("  ", None)):
        assert pick(text.family_from_text(F.lit(said))) == family
    assert pick(text.is_followup(F.lit("  Go   ahead!! "))) and not pick(text.is_followup(F.lit("go away")))
    assert pick(text.words(F.lit("Été des x1 naïfs naïfs"))) == ["été", "des", "naïfs"]


def test_sensitive_text(spark):
    said = "see /home/ann/x\nmail ann@corp.io or a@example.com\nhttps://x.test/a https://docs.example.com\nProject Zorb here\nzorb"
    got = textscan.scan_text(spark.createDataFrame([(1, said)], "id long, text string"), "id", "text", ["Zorb"]).collect()
    assert sorted((r["line"], r["kind"], r["value"]) for r in got) == [
        (1, "home path", "/home/ann"), (2, "email", "ann@corp.io"), (3, "domain", "x.test"), (4, "denied term", "zorb"), (5, "denied term", "zorb")]


def test_leak_free_bounds_are_earlier_values(spark):
    ys = [5, 9, 2, 7, 7, 3, 8, 1, 50, 4]
    df = spark.createDataFrame([("s", i, i * MINUTE, y) for i, y in enumerate(ys)], "session_key string, task_id long, started_us long, y long")
    rows = backtest.leak_free(df, "y", {"lo": 0.0, "hi": 1.0}).collect()
    assert {r["task_id"]: (r["lo"], r["hi"]) for r in rows} == {8: (1, 9), 9: (1, 50)}


def test_quantile_tree_splits_on_the_telling_sign(spark):
    """Labels a and b mean few turns, c many; a second sign says nothing. Unseen labels and missing ones go right."""
    rows = [(1, i, i, 40 if i % 3 == 2 else 2) for i in range(300)]
    tasks = spark.createDataFrame(rows, "session_key long, task_id long, started_us long, y long")
    told = [(1, i, "kind", "abc"[i % 3]) for i in range(300) if i != 299] + [(1, i, "noise", "xy"[i // 3 % 2]) for i in range(300)]
    labels = spark.createDataFrame(told, "session_key long, task_id long, sign string, label string")
    got = tree.quantile_tree(tasks, labels, ["noise", "kind"]).filter("method = 'tree depth 2'").collect()
    assert len(got) == 90
    assert all((r.lo, r.mid, r.hi) == (r.y, r.y, r.y) for r in got)


def test_quantile_tree_stays_whole_where_no_cut_helps(spark):
    tasks = spark.createDataFrame([(1, i, i, 5) for i in range(100)], "session_key long, task_id long, started_us long, y long")
    labels = spark.createDataFrame([(1, i, "kind", "ab"[i % 2]) for i in range(100)], "session_key long, task_id long, sign string, label string")
    rows = tree.with_signs(tasks, labels, ["kind"]).selectExpr("1 AS node", "y", "signs")
    assert tree.best_splits(rows).isEmpty()

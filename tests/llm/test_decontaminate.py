import random
from collections import Counter, defaultdict

import pytest

from callmeter.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


def shingles(words):
    return Counter(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


def plain(docs, items, least=0.8):
    """(row, item): best similarity over all item-sized windows that share a shingle laid as in the item."""
    found = {}
    at = defaultdict(list)
    parts = {i: (t or "").lower().split() for i, t in items}
    for i, w in parts.items():
        for j in range(max(len(w) - 4, 1)) if w else ():
            at[tuple(w[j:j + 5])].append((i, j))
    for row, t in enumerate(docs):
        words = (t or "").lower().split()
        for size in {min(len(w), 5) for w in parts.values() if w}:
            for p in range(len(words) - size + 1):
                for i, j in at.get(tuple(words[p:p + size]), ()):
                    w = parts[i]
                    s = max(p - j, 0)
                    a, b = shingles(words[s:s + len(w)]), shingles(w)
                    sim = sum((a & b).values()) / sum((a | b).values())
                    if sim >= least:
                        found[row, i] = max(sim, found.get((row, i), 0))
    return found


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(40)] + [(90, None), (91, " "), (92, "two words"), (93, "a b c d e"), (3, "same id again but other words here")]
    docs = []
    for k in range(200):
        w = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            own = items[rng.randrange(40)][1].split()
            if k % 4 == 1:  # loses words at its ends
                own = own[rng.randint(0, 2):len(own) - rng.randint(0, 3)]
            if k % 6 == 1:  # one word changed
                own[rng.randrange(len(own))] = word()
            cut = rng.randint(0, len(w))
            w = w[:cut] + own + w[cut:]
        docs.append(" ".join(w))
    return docs + [None, "", "Two  WORDS", "x A b C d e y", docs[1], docs[1]], items


@pytest.mark.parametrize("bound", [200_000, 0])
def test_against_brute_force(spark, docs, made, bound):
    texts, items = made
    got = decontaminate.leaks(docs(list(enumerate(texts))), spark.createDataFrame(items, ITEMS), bound=bound).collect()
    want = plain(texts, [(i, t) for i, t in items if i != 3])
    mine = {(r.doc_id, r.item_id): r.similarity for r in got if r.item_id != 3}
    assert mine == pytest.approx(want)
    assert len(want) > 60


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = plain([d.text for d in docs], [(i.item_id, i.text) for i in items])
    got = queries.QUERIES["op7_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx({(docs[d].doc_id, i): s for (d, i), s in want.items()})


def test_clean_keeps_the_rest_and_empty_tables_pass(spark, docs, made):
    texts, items = made
    d, b = docs(list(enumerate(texts))), spark.createDataFrame(items, ITEMS)
    kept = decontaminate.clean(d, b)
    hit = {row for row, i in plain(texts, [(i, t) for i, (_, t) in enumerate(items)])}
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in hit]
    assert decontaminate.leaks(d.limit(0), b).count() == 0
    assert decontaminate.leaks(d, b.limit(0)).count() == 0


def test_a_window_within_the_radius_is_always_looked_up(spark):
    rng = random.Random(9)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = []
    for _ in range(200):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 20)):
            b ^= 1 << bit
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long").select(decontaminate.blocks("a", 2).alias("x"), decontaminate.blocks("b").alias("y"))
    assert df.selectExpr("arrays_overlap(x, y) AS met").filter("met").count() == 200


def test_main_path_without_python(spark, docs):
    d, b = docs([(1, "a b c d e f g")]), spark.createDataFrame([(1, "b c d e f")], ITEMS)
    plan = decontaminate.leaks(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def every_window(docs, items, least=0.8):
    """(row, item): best similarity over the windows at every start; those that the text's end cuts, between the outer alignments only."""
    found = {}
    for row, t in enumerate(docs):
        words = (t or "").lower().split()
        for i, x in items:
            w = (x or "").lower().split()
            b = shingles(w)
            size = min(len(w), 5)
            laid = [max(p - j, 0) for p in range(len(words) - size + 1) for j in range(len(w) - size + 1) if words[p:p + size] == w[j:j + size]]
            for s in range(len(words)) if laid else ():
                if s + len(w) > len(words) and not min(laid) <= s <= max(laid):
                    continue
                a = shingles(words[s:s + len(w)])
                shared = sum((a & b).values())
                sim = shared / (sum(a.values()) + sum(b.values()) - shared)
                if sim >= least:
                    found[row, i] = max(sim, found.get((row, i), 0))
    return found


@pytest.mark.parametrize("bound", [200_000, 0])
def test_windows_at_every_start(spark, docs, bound):
    """Words put in or left out in the middle, and changed ends: the best window lies between two alignments."""
    w = [f"w{i}" for i in range(59)]
    texts = [" ".join(["p", "q", "r", "x", *w[1:30], "in", "to", *w[30:58], "y", "s", "t", "u"])]
    rng = random.Random(21)
    items = [(0, " ".join(w))] + [(k, " ".join(f"i{k}x{rng.randrange(40)}" for _ in range(rng.randint(14, 59)))) for k in range(1, 12)]
    for _ in range(60):
        own = items[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(own))
            own[at:at + rng.randint(0, 1)] = ["z"] * rng.randint(0, 2)
        own[0], own[-1] = rng.choice([own[0], "f"]), rng.choice([own[-1], "g"])
        texts.append(" ".join(["a"] * rng.randint(0, 4) + own + ["b"] * rng.randint(0, 4)))
    want = every_window(texts, items)
    got = decontaminate.leaks(docs(list(enumerate(texts))), spark.createDataFrame(items, ITEMS), bound=bound).collect()
    assert want[0, 0] == pytest.approx(49 / 61) and (0, 0) not in plain(texts[:1], items[:1])
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_short_items_inside_long_texts_and_items_without_id(spark, docs, bound):
    items = [(1, "solo"), (2, "two words"), (3, "now three words"), (4, "these are four words"), (None, "an item that has no id at all")]
    texts = [f"some text before {t} and then some more of it" for _, t in items] + ["solo", "nothing here", None]
    d, b = docs(list(enumerate(texts))), spark.createDataFrame(items, ITEMS)
    got = decontaminate.leaks(d, b, bound=bound).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == every_window(texts, items) == {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1, (4, None): 1, (5, 1): 1}
    assert sorted(r.doc_id for r in decontaminate.clean(d, b, bound=bound).collect()) == [6, 7]
    assert decontaminate.leaks(d, b.limit(0), bound=bound).count() == 0


def test_looking_up_blocks_is_a_small_expression(spark):
    """a struct for each of 296 values made plans and generated code that the driver held."""
    made = spark.range(1).select(decontaminate.blocks("id", 2).alias("b"))
    assert made._jdf.queryExecution().analyzed().toString().count("block") < 20 and len(made.first().b) == 296

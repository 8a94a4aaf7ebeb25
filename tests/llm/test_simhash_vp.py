import random

import numpy as np
import pytest
import xxhash

from callmeter.llm import queries, simhash_vp

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def test_fingerprints(docs):
    rng = random.Random(3)
    texts = ["", None, " \t\n", "One", "One two", "one TWO three", "É é x y", "a b c " * 2000] + [
        " ".join(rng.choice(["Foo", "bär", "x", " y"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = {r.doc_id: r.fp % 2**64 for r in simhash_vp.fingerprints(docs(list(enumerate(texts))), "doc_id").collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [8192, 20])
def test_links_against_all_pairs(spark, block):
    """Random fingerprints with chains, dense balls and near misses, at every number of levels."""
    rng = random.Random(7)
    fps = [0, 1, 2**64 - 1]
    for n in (400, 30):
        base = rng.getrandbits(64)
        for _ in range(n):
            x = base if n == 400 else fps[-1]
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps + [rng.getrandbits(64) for _ in range(600)]))
    want = plain_components(fps)
    ids = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, fp long")
    edges = simhash_vp.links(df.select("fp"), block=block)
    assert edges.count() <= 20 * len(fps)
    from callmeter.llm.components import components
    root = {r.node: r.root for r in components(edges).collect()}
    place = {x: i for i, x in enumerate(ids)}
    smallest = {}
    for i, x in enumerate(ids):
        smallest.setdefault(root.get(x, x), i)
    assert [smallest[root.get(x, x)] for x in ids] == [min(j for j in range(len(fps)) if want[j] == w) for w in want]
    assert set(root) <= set(place)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_overlapping_shards_hold_every_near_pair_once(spark, levels):
    rng = random.Random(levels)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
            b ^= 1 << bit
        pairs.append((a, b))
    fps = sorted({x for p in pairs for x in p})
    ids = dict(zip(fps, np.array(fps, np.uint64).view(np.int64).tolist()))
    held = {}
    for r in simhash_vp.shards(spark.createDataFrame([(x,) for x in ids.values()], "fp long"), levels, 3).collect():
        held.setdefault(r.fp, {})[r.shard] = r.home
    for a, b in pairs:
        common = [s for s in set(held[ids[a]]) & set(held[ids[b]]) if held[ids[a]][s] or held[ids[b]][s]]
        assert common


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    want = plain_components(fps)
    low = {w: min(docs[i].doc_id for i in range(len(docs)) if want[i] == w) for w in set(want)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash_near_dedup"](spark, SF).collect()}
    assert got == {r.doc_id: (f"{fps[i]:016x}", low[want[i]]) for i, r in enumerate(docs)}


def test_edge_cases_and_one_row_of_each_group(spark, docs):
    text = "some words that make up a text of a few shingles"
    d = docs([(4, text), (2, text), (2, text), (9, "quite another text with its own words in it"), (None, None), (None, ""), (7, ""), (None, "alone in the world with no id")])
    rows = simhash_vp.near_duplicates(d).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [
        ("2", "2"), ("2", "2"), ("4", "2"), ("7", "7"), ("9", "9"), ("None", "7"), ("None", "7"), ("None", "None")]
    kept = simhash_vp.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "9", "None"]
    assert simhash_vp.near_duplicates(d.limit(0)).count() == 0
    assert simhash_vp.keep_one(d.limit(0)).count() == 0

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from callmeter.llm import components, near_copies, simhash_vp


def plain_kept(rows):
    """Smallest doc_id of each group that pairs of five-word Jaccard similarity 0.8 or more connect, over all pairs that share a shingle."""
    sets, at, shared = [], defaultdict(list), Counter()
    for i, (_, t) in enumerate(rows):
        w = (t or "").lower().split()
        sets.append({tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else {()})
        for s in sets[-1]:
            for j in at[s]:
                shared[j, i] += 1
            at[s].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (i, j), n in shared.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted(min(v) for v in low.values())


@pytest.mark.parametrize("bytes_a_bucket", [near_copies.BUCKET_BYTES, 2_000])
def test_stage_against_all_pairs(spark, docs, monkeypatch, bytes_a_bucket):
    """Copies with few to many changed words, chains, a common passage, texts of all lengths, blanks."""
    monkeypatch.setattr(near_copies, "BUCKET_BYTES", bytes_a_bucket)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    passage, texts = [word() for _ in range(40)], [None, "", " \t\n", "One", "one", "two words", "a b c d e", "A b c d E"]
    for k in range(25):
        own = [word() for _ in range(rng.randint(5, 150))]
        own = passage + own if k % 3 == 0 else own
        for _ in range(rng.randint(1, 8)):
            new = list(own)
            for _ in range(rng.randint(0, 1 + len(own) // 40)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new if rng.random() < 0.8 else new[:int(len(new) * rng.uniform(0.75, 1))]))
            own = new if rng.random() < 0.3 else own  # a chain goes on from the last copy
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    want = plain_kept(rows)
    got = corpus_pipeline.near_dedup(spark, docs(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(rows) - 30


@pytest.mark.parametrize("order", ["none", "all", "turned round"])
def test_any_order_of_shingles_keeps_the_same_documents(spark, docs, monkeypatch, order):
    """the sample of common shingles only orders the prefixes; no pair hangs on it."""
    rng = random.Random(21)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    passage, rows = words(30), []
    for g in range(15):
        own = passage + words(rng.randint(60, 120))
        rows += [(10 * g + i, t) for i, t in enumerate(altered(rng, own, 1, 4))]

    def common(texts, n):
        every, count = np.unique(np.concatenate([near_copies.shingle_set(t.encode()) for _, t in rows]), return_counts=True)
        return {"none": (every[:0], count[:0]), "all": (every, count), "turned round": (every, -count)}[order]
    monkeypatch.setattr(near_copies, "common_shingles", common)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs(rows)).collect()) == plain_kept(rows)
    assert len(plain_kept(rows)) < len(rows) - 5


def test_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    kept = corpus_pipeline.near_dedup(spark, d, "").collect()
    assert sorted(r.doc_id for r in kept) == plain_kept(rows)
    assert not {2, 56} <= {r.doc_id for r in kept} and not {709, 944} <= {r.doc_id for r in kept}


def altered(rng, words, k, n):
    """n texts: words with k of them changed."""
    return [" ".join("new" + str(rng.randrange(10**9)) if i in at else w for i, w in enumerate(words)) for at in (set(rng.sample(range(len(words)), k)) for _ in range(n))]


def test_vantage_point_trees_alone_find_what_fingerprints_show(spark, docs, monkeypatch):
    """Without prefix filtering: the pairs within seven bits are linked, and of these the ones of similarity 0.8 or more are one document."""
    rng = random.Random(5)
    texts = [t for g in range(20) for t in altered(rng, [f"w{g}x{rng.randrange(500)}" for _ in range(400)], 2, 3)] + ["", "one two three", "One two  three"]
    fps = [simhash_vp.fingerprint(t.encode(), 5) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= near_copies.RADIUS}
    places = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "__place long, text string")
    found = {(r.a, r.b) for r in near_copies.fingerprint_pairs(places).collect()}
    assert len(found & near) > 30
    root = lambda edges: {r.node: r.root for r in components.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert root(found) == root(near)
    monkeypatch.setattr(near_copies, "ROUNDS", ())
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(list(enumerate(texts))), "").collect()}
    assert len(kept) < 40 and kept >= set(plain_kept(list(enumerate(texts))))


@pytest.mark.parametrize("parts, radius", [(2, 3), (4, 7)])
def test_trees_over_parts_miss_no_pair_within_the_radius(spark, parts, radius):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(6000)]
    fps = sorted({*fps, *(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1))) for x in fps[:1500])})
    signed = {x - 2**64 if x >= 2**63 else x for x in fps}
    edges = simhash_vp.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, block=700, parts=parts)
    got = {r.node: r.root for r in components.components(edges).collect()}
    a = np.array(sorted(signed), np.int64)
    want = [(int(a[i]), int(a[j])) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i].view(np.uint64) ^ a.view(np.uint64)) <= radius) if i < j]
    assert got == {r.node: r.root for r in components.components(spark.createDataFrame(want, "a long, b long")).collect()} and len(want) > 1000


def test_components_are_made_again_only_for_new_pairs(spark, docs, monkeypatch):
    """each call is a dozen jobs, whose plans, threads and broadcasts the driver holds."""
    made, real = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges: made.append(1) or real(edges))
    text = " ".join(f"w{chr(97 + k % 26)}{k}" for k in range(60))
    rows = [(1, text), (2, text + " end"), (3, "something else that is like no other text here"), (4, None)]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs(rows)).collect()) == [1, 3, 4]
    assert len(made) <= 2

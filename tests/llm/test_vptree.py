import math

import numpy as np
import pytest

from callmeter.llm import queries, vptree

SF = "/root/testdata/sf0.01"


def plain(rows, queries, k):
    usable = {i: np.array(x, float) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)}
    out = set()
    for q in queries:
        if q in usable:
            d = sorted((float(np.sqrt(((usable[q] - x) ** 2).sum())), i) for i, x in usable.items() if i != q)
            out |= {(q, r, i, round(s, 9)) for r, (s, i) in enumerate(d[:k], 1)}
    return out


def rows_of(df):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 12] + 0.05 * rng.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector holds a quarter of all rows
    return rows + [(5000, None), (5100, [0.0] * 8), (5200, [math.nan] + [1.0] * 7), (5300, [None] + [1.0] * 7), (5400, [math.inf] + [1.0] * 7)]


@pytest.mark.parametrize("size", [{}, {"sample": 64, "shard_rows": 100, "leaf": 8, "block": 16, "asked_rows": 5}])
def test_factor_one_is_exact(spark, vectors, size):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = vptree.nearest(df, df.filter("vec_id % 100 = 0"), k=10, **size)
    assert rows_of(got) == plain(vectors, [i for i, _ in vectors if i % 100 == 0], 10)


def test_a_smaller_factor_visits_less_and_keeps_its_recall(spark, vectors):
    rng = np.random.default_rng(0)
    x = np.array([v for i, v in vectors[:900]])
    tree = vptree.build(x, np.arange(900), 16, rng)
    seen = {}
    for factor in (1.0, 0.5):
        hits = visited = 0
        for q in range(0, 900, 30):
            best = vptree.Best(x[[q]], np.array([q]), np.array([np.inf]), 10)
            for node, active in vptree.leaves(tree, x[[q]], best.bound, factor):
                best.offer(active, x[node.rows], node.rows)
                visited += len(node.rows)
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            hits += len(set(np.argsort(d)[:10]) & set(best.ids[0]))
        seen[factor] = hits / 300, visited
    assert seen[1.0][0] == 1 and seen[0.5][0] >= 0.9 and seen[0.5][1] < seen[1.0][1] < 900 * 30


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op4_nearest_vectors"](spark, SF)) == plain(rows, [i for i, _ in rows if i % 100 == 0], 10)


def test_few_rows_repeats_and_an_empty_table(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows_of(vptree.nearest(df, df.filter("vec_id = 100"))) == {(100, 1, 2, round(math.sqrt(2), 9))}
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0

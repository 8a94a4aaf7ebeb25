import zlib
from collections import defaultdict

import numpy as np

from callmeter.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_plain_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert list(sharding.jump(keys, n)) == [plain_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b]) == {8} and 20 < (a != b).sum() < 110


def test_whole_table(spark):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    slots = defaultdict(list)
    for r in rows:
        data = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (plain_jump(r.doc_id, 8), plain_jump(r.doc_id, 9))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_nulls_repeats_and_an_empty_table(spark, docs):
    d = docs([(None, None), (5, ""), (5, ""), (5, "äb"), (-3, "x" * 100_000)])
    rows = sharding.shard_documents(d).collect()
    assert sorted(r.size for r in rows) == [1, 1, 1, 4, 100_001]
    assert {r.shard for r in rows if r.doc_id is None} == {plain_jump(2**64 - 1, 8)}
    fives = [r for r in rows if r.doc_id == 5]
    assert len({r.shard for r in fives}) == 1 and len({r.slot for r in fives}) == 3
    assert sharding.shard_documents(d.limit(0)).count() == 0

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callmeter.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def hold(rows, ids):
    """rows place every id of `ids` (a list of (doc_id, ids) pairs) once, in windows without gaps; returns the padding."""
    whole, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(int)
    for i, x in ids:
        want[i, len(x)] += 1
    assert {k: sum(r.length for r in v) for k, v in whole.items()} == {k: k[1] * n for k, n in want.items()}
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    by_id = {i: x for i, x in ids}
    for (i, _), v in whole.items():
        for r in v:
            if want[i, r.doc_tokens] == 1 and len([1 for j, _ in ids if j == i]) == 1:
                assert r.ids_crc32 == zlib.crc32(np.array(by_id[i][r.start:r.start + r.length], "<u4").tobytes())
    return padding


def test_ids_are_those_of_the_tokenizer(plain):
    rng = random.Random(2)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\xa0", "　", "é", "12", "'s", "<|endoftext|>", ".", "\x1c", "日本", "_", "###"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert [*packing.encoder(packing.RANKS).ids(text), 1] == plain(text), repr(text)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "\U00010940\U000323b0 x\u0558", "".join(chr(rng.randrange(0xE000, 0x110000)) for _ in range(3000))):
        assert [*packing.encoder(packing.RANKS).ids(text), 1] == plain(text), repr(text)
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275, 1]


def test_fast_encoder_agrees_on_every_stable_code_point(plain):
    e = packing.encoder(packing.RANKS)
    stable = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not e.unstable(chr(c))]
    for k in range(0, len(stable), 40):
        text = "".join(f"a{c}1{c}.{c} {c}\n" for c in stable[k:k + 40])
        assert [*e.ids(text), 1] == plain(text)


def test_whole_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.QUERIES["op5_packing"](spark, SF).collect()
    ids = [(d.doc_id, plain(d.text)) for d in docs]
    assert hold(rows, ids) <= 2048


def test_several_shards_nulls_and_repeats(spark, docs, plain):
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice(["the", "cat", "sat", "häuser", "x"]) for _ in range(rng.randint(1, 3000)))) for i in range(60)]
    made += [(100, "a <|endoftext|> b"), (104, None), (101, ""), (7, "one more row of this id"), (None, "no id"), (102, "again and again " * 20), (102, "again and again " * 20)]
    d = docs(made)
    rows = packing.pack(d, shard_tokens=20_000).collect()
    shards = len({r.sequence_id >> 32 for r in rows})
    assert shards > 1 and hold(rows, [(i, plain(t)) for i, t in made]) <= 2048 * shards
    assert packing.pack(d.limit(0)).count() == 0


def test_statistics_cover_every_document(spark, docs):
    tokens = packing.tokenize(docs([(1, "the cat"), (2, "the the dog"), (3, None)]), packing.RANKS)
    df, n, total = packing.statistics(tokens, np.uint16, 50257)
    ids = {r.doc_id: np.frombuffer(r.ids, np.uint16) for r in tokens.collect()}
    assert n == 3 and total == sum(map(len, ids.values()))
    assert all(df[t] == sum(t in set(x.tolist()) for x in ids.values()) for x in ids.values() for t in x.tolist())


def test_neighbours_by_bm25_score():
    docs = [np.array(x) for x in ([5, 6, 7], [5, 6, 9], [5, 8, 8], [9, 9, 9], [4])]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=10)
    idf, mean = np.log(1 + (5 - df + 0.5) / (df + 0.5)), sum(map(len, docs)) / 5

    def bm25(q, d):
        return sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()))
    index = packing.Index(docs, idf, mean)
    for i, q in enumerate(docs):
        scores = {j: bm25(q, d) for j, d in enumerate(docs) if j != i and bm25(q, d) > 0}
        assert list(index.neighbours(i)) == sorted(scores, key=lambda j: (-scores[j], j))


def test_a_window_takes_the_neighbours_first():
    pieces = packing.fill([1000, 900, 500, 400], lambda d: [3, 2] if d == 0 else [])
    first = [(d, s, n) for d, s, n, q, _ in pieces if q == 0]
    assert first == [(0, 0, 1000), (3, 0, 400), (2, 0, 500), (1, 0, 148)]
    assert [(d, s, n) for d, s, n, q, _ in pieces if q == 1] == [(1, 148, 752)]


def test_shards_hold_likenesses_and_no_hot_group(spark, docs):
    """Near copies share a shard, copies in thousands are divided."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    made, group = [], {}
    for g in range(60):
        own = [word() for _ in range(60)]
        for _ in range(3):
            group[len(made)] = g
            made.append((len(made), " ".join([*own[:57], word(), word()])))
    made += [(k + 1000, "the same text in very many rows of the table") for k in range(1500)]
    tokens = packing.tokenize(docs(made), packing.RANKS)
    df, n, total = packing.statistics(tokens, np.uint16, 50257)
    shards = 4
    rows = packing.dealt(tokens, df, np.uint16, n, shards, total // shards).collect()
    assert len(rows) == len(made)
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += len(r.ids) // 2
    assert max(held.values()) < 4 * total / shards
    at = {r.doc_id: r.shard for r in rows}
    together = sum(at[3 * g] == at[3 * g + 1] for g in range(60))
    assert together > 40


def test_a_document_asks_with_all_its_terms():
    docs = [np.arange(100), np.array([99, 200]), np.array([0, 201]), np.array([300])]
    index = packing.Index(docs, np.linspace(1, 2, 400), 30.0)
    assert sorted(index.neighbours(0)) == [1, 2]

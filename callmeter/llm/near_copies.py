"""Near copies: SimHash fingerprints linked through vantage-point trees, then exact similarity of sets of five-word shingles.

What no fingerprint can show, as the bits of a pair of similarity 0.8 differ by about ten and at times by twenty, is found by prefix filtering.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm import simhash_vp
from callmeter.llm.common import SPACES, release, slices, small, text_batches, written
from callmeter.llm.components import components

SHINGLE = 5
#: Differing bits at which fingerprints are candidates, and the parts of the bits that have a vantage-point tree each.
RADIUS, PARTS = 7, 4
#: Documents that are looked at for common shingles: so many at least, and one of SHARE at least, so that the lists of uncommon ones do not
#: grow with the input; in how many of them one is common, how many are known, and bytes of text a bucket of the index.
SAMPLE, SHARE, COMMON, KNOWN, BUCKET_BYTES = 5_000, 8, 3, 300_000, 12_000_000


#: From how many to how many places on in a shingle's list a text is paired with others, round by round; the last round takes all the rest.
ROUNDS = ((1, 16), (17, 128), (129, None))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles of UTF-8 text in order, A-Z in lower case; fewer words are one shingle, none: no hash."""
    words = (text or b"").lower().split()
    whole = [b" ".join(words)] if words else []
    each = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else whole
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), each), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets of 4/5 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a hash, a power of two long: the bit of a hash is its remainder."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    held = np.zeros(bits, bool)
    held[hashes & np.uint64(bits - 1)] = True
    return np.packbits(held, bitorder="little")


def may_be_similar(a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
    """Whether sets of n and m hashes with these bitmaps can be similar. They share no more hashes than bits, and those that share a bit of one set."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    one, two, both = (int(np.bitwise_count(x).sum()) for x in (a, b, a & b))
    return 9 * (both + min(n - one, m - two)) >= 4 * (n + m)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles of a set of n, uncommon ones first, then by how common they are.

    Any fixed order of all shingles will do: two similar sets share at least 4/5 of the larger one and 8/9 of the smaller one, so the first
    shingle that they share stands among the first n // 5 + 1 of the larger and the first n // 9 + 1 of the smaller.
    """
    n = len(hashes)
    if not n:
        return hashes
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, rank[at], 0)
    return hashes[np.lexsort((hashes, weight))[: n // 5 + 1]]


def common_shingles(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample and their counts. They only order the prefixes: the result is the same whatever they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingle_set(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    part = texts.filter(F.pmod(F.xxhash64("__place"), F.lit(max(1, min(SHARE, rows // SAMPLE)))) == 0).select("text")
    counts = part.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "h").limit(KNOWN).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def index(texts: DataFrame, rows: int, size: int) -> DataFrame:
    """(bucket, h, place, meta) of the shingles that stand in the prefixes of two texts or more; meta is the size of the set and the place in its order."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, rows))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            heads = [prefix(s, *shared.value) for s in sets]
            k = np.array([len(x) for x in heads], np.int64)
            n = np.repeat(np.array([len(s) for s in sets], np.int64), k)
            pos = np.concatenate([np.zeros(0, np.int64), *map(np.arange, k)])
            h = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(n << 32 | pos)], ["h", "place", "meta"])

    def several(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy()
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        release()
        return t.filter(pa.array(n[at] > 1))

    buckets = max(1, -(-size // BUCKET_BYTES))
    every = texts.select(F.col("__place").alias("place"), "text").mapInArrow(emit, "h long, place long, meta long")
    dealt = every.select(F.pmod("h", F.lit(buckets)).alias("bucket"), "h", "place", "meta")
    return written(dealt.groupBy("bucket").applyInArrow(several, "bucket long, h long, place long, meta long"), "prefixes")


def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two sets, the first not larger, can be similar with this as the first shingle that they share."""
    nx, ny, i, j = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
    return (5 * nx >= 4 * ny) & (i <= nx // 9) & (9 * np.minimum(nx - i, ny - j) >= 4 * (nx + ny))


def pairs(found: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(a, b): places of texts of unlike label that share a shingle of their prefixes and can be similar. found: (bucket, h, place, meta, label).

    The texts of a shingle stand by size. Each is paired with those `first` to `last` places on; without `last`, with all from `first` on.
    """
    def run(t: pa.Table) -> pa.Table:
        h, place, meta, label = (t.column(c).to_numpy() for c in ("h", "place", "meta", "label"))
        order = np.lexsort((place, meta >> 32, h))
        h, place, meta, label = h[order], place[order], meta[order], label[order]
        end = np.searchsorted(h, h, side="right")
        out, left = [np.zeros((0, 2), np.int64)], np.arange(len(h))
        for step in range(first, last + 1) if last else count(first):
            left = left[left + step < end[left]]
            left = left[5 * (meta[left] >> 32) >= 4 * (meta[left + step] >> 32)]  # later ones are larger still
            if not len(left):
                break
            other = left + step
            good = (label[left] != label[other]) & possible(meta[left], meta[other])
            out.append(np.sort(np.stack([place[left[good]], place[other[good]]], 1), axis=1))
            if len(out) > 256:
                out = [np.unique(np.concatenate(out), axis=0)]
        both = np.unique(np.concatenate(out), axis=0)
        del h, place, meta, label, out
        release()
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return found.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def verified(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (a, b) that are similar. Bitmaps of their shingles go first: only what these leave open is compared shingle by shingle."""
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                                             ["place", "n", "own"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingle_set(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                                             ["place", "n", "own"])

    def compared(exact: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                x, y = ([np.frombuffer(s.as_buffer(), np.uint64 if exact else np.uint8) for s in b.column(i)] for i in (4, 5))
                n, m = b.column(2).to_pylist(), b.column(3).to_pylist()
                good = pa.array([similar(p, q) if exact else may_be_similar(p, i, q, j) for p, i, q, j in zip(x, n, y, m)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])
        return run

    def kept(left: DataFrame, make, exact: bool) -> DataFrame:
        wanted = written(left.select(F.col("a").alias("__place")).distinct().union(left.select("b").distinct()).distinct(), "wanted")
        held = written(texts.join(small(wanted), "__place", "left_semi").select("__place", "text").mapInArrow(make, "place long, n long, own binary"), "sets")
        one, two = held.toDF("a", "n", "x"), held.toDF("b", "m", "y")
        return left.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(compared(exact), "a long, b long")

    return kept(written(kept(candidates, sketches, False), "open"), sets, True)


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): places of texts (__place, text) that vantage-point trees over the SimHashes of their five-word shingles link.

    Texts with one fingerprint are linked to the first of them, so a group of n texts gives n pairs at most.
    """
    fps = written(simhash_vp.fingerprints(texts, "__place", width=SHINGLE), "fps")
    leads = written(fps.groupBy("fp").agg(F.min("__place").alias("lead")), "leads")
    edges = written(simhash_vp.links(leads.select("fp"), RADIUS, parts=PARTS).distinct(), "fp-links")
    lead, places = small(leads), [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    same = fps.join(lead, "fp").filter("__place <> lead").select(F.col("lead").alias("x"), F.col("__place").alias("y"))
    near = edges.join(lead.toDF("a", "x"), "a").join(lead.toDF("b", "y"), "b").select("x", "y")
    return same.union(near).select(*places).distinct()


def links(texts: DataFrame, rows: int, size: int) -> DataFrame:
    """(node, root) of the places of texts (__place, text) that chains of similar pairs connect.

    The pairs that fingerprints link come first. Then each text is held against the next ones in each shingle's list, and only against
    those it is not yet connected with. That joins groups of near copies, however large, with some links a member; then all pairs that are
    still not connected are looked at.
    """
    seen = written(fingerprint_pairs(texts), "tried")
    near = written(verified(texts, seen), "near")
    root = components(near)
    if not ROUNDS:
        return root
    found = index(texts, rows, size)
    for first, last in ROUNDS:
        label = root.select(F.col("node").alias("place"), F.col("root").alias("label"))
        named = found.join(small(label), "place", "left").withColumn("label", F.coalesce("label", "place"))
        tried = written(pairs(named, first, last).join(small(seen), ["a", "b"], "left_anti"), "tried")
        if tried.isEmpty():
            continue
        more, seen = written(verified(texts, tried), "near"), seen.union(tried)
        if not more.isEmpty():  # else the components are those that are known
            near = near.union(more)
            root = components(near)
    return root


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of near copies left, the one with the smallest doc_id (of several, the first in the input).

    Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; groups are all that chains
    of such pairs reach: SimHash and vantage-point trees find most close pairs, prefix filtering the others. No pair is missed and none is taken for one (64-bit hashes stand for shingles). Texts without words are copies of each other.
    A row without doc_id gives way to any with one; repeated rows are copies. Long texts are compared whole. No rows: none. All columns stay.
    """
    text_batches(documents.sparkSession)
    placed = documents.withColumn("__place", F.monotonically_increasing_id())
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    rows = written(placed.select("__place", F.md5(bare.cast("binary")).alias("key"), F.octet_length(bare).alias("size"),
                                 F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__place")).alias("order")), "rows")
    again = rows.groupBy("key").agg(F.min("__place").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    led = written(rows.join(small(written(again, "again")), "key", "left").withColumn("lead", F.coalesce("lead", "__place")).drop("key"), "led")
    copies = led.filter("lead <> __place").select("__place")
    texts = placed.select("__place", F.col("text").cast("binary").alias("text")).join(small(written(copies, "copies")), "__place", "left_anti")
    n, size = led.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    root = links(texts, n, size).select(F.col("node").alias("lead"), "root")
    marked = written(led.join(small(written(root, "roots")), "lead", "left").select("__place", "order", F.coalesce("root", "lead").alias("root")), "named")
    first = written(marked.groupBy("root").agg(F.min("order").alias("order")).select(F.col("order.__place").alias("__place")), "first")
    others = written(marked.select("__place").join(first, "__place", "left_anti"), "others")
    return placed.join(small(others), "__place", "left_anti").drop("__place")

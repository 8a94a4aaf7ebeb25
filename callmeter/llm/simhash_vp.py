"""SimHash near-duplicates, linked through vantage-point trees over Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import small, written
from callmeter.llm.components import components

BITS, HALF = 64, 32
#: By the number of parts that have a tree each: the distances from a vantage point that random bits of one part spread over, 2 ** entropy of
#: a binomial(64 / parts, 1/2), the most levels of sharding, and how many members a shard is to have.
TREES = {2: (11.7, 6, 256), 4: (8.3, 4, 512)}
#: Vantage points of the sharding levels of each half; later ones serve the trees inside a shard.
VANTAGE = [[int(x) for x in np.random.default_rng(half).integers(0, 1 << HALF, 24)] for half in (0, 1)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the shingles of `width` words of UTF-8 text, A-Z in lower case; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    if len(words) < width:
        return digest(b" ".join(words))
    n = len(words) - width + 1
    h = np.fromiter(map(digest, map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, *keep: str, width: int = 3) -> DataFrame:
    """The columns `keep` of documents and `fp`, the fingerprint as a signed long; null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(0)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps)], [*keep, "fp"])

    rows = documents.select(F.col("text").cast("binary").alias("__text"), *keep)
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return rows.mapInArrow(run, schema)


def steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Changes of the distances to `levels` vantage points that `radius` flipped bits can make, those to a later shard only.

    By the triangle inequality none exceeds the number of flipped bits, and each has that number's parity.
    """
    near = [d for d in product(range(-radius, radius + 1), repeat=levels) if len({x % 2 for x in d}) == 1]
    return [d for d in near if d > (0,) * levels]


def shards(fps: DataFrame, levels: int, radius: int, parts: int = 2) -> DataFrame:
    """(shard, home, fp): each fingerprint in its home shard, and in every later shard that its boundaries overlap, for each part of the bits.

    Two fingerprints within R bits agree within R // parts in one part, so a tree over each part with that radius misses no pair.
    A shard is the tuple of distances to the vantage points.
    """
    bits = BITS // parts

    def cells(part: int) -> Column:
        value = F.shiftrightunsigned("fp", bits * part).bitwiseAND(F.lit((1 << bits) - 1))
        points = [(VANTAGE[0][i] | VANTAGE[1][i] << HALF) >> bits * part & (1 << bits) - 1 for i in range(levels)]
        away = [F.bit_count(value.bitwiseXOR(F.lit(p))).cast("long") for p in points]
        home = sum((d * 64 ** (levels - 1 - i) for i, d in enumerate(away)), F.lit(part * 64**levels).cast("long"))
        moves = [(sum(x * 64 ** (levels - 1 - i) for i, x in enumerate(s)), s) for s in steps(levels, radius // parts)]
        valid = [F.when(F.expr("true") if not s else _all([(d + x).between(0, bits) for d, x in zip(away, s)]), home + m) for m, s in moves]
        return F.transform(F.array(home, *valid), lambda c, i: F.struct(c.alias("shard"), (i == 0).alias("home")))

    every = F.concat(*map(cells, range(parts)))
    return fps.select("fp", F.explode(every).alias("c")).select("c.shard", "c.home", "fp").filter("shard is not null")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, level: int, leaf: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) at `radius` bits or less: a vantage-point tree in memory, with branches cut by the triangle inequality."""
    todo = [(np.arange(len(a)), np.arange(len(b)), level)]
    while todo:
        i, j, level = todo.pop()
        if len(i) <= leaf or level >= 24:
            for at in range(0, len(i), 64):
                part = i[at:at + 64]
                x, y = np.nonzero(np.bitwise_count(a[part][:, None] ^ b[j][None, :]) <= radius)
                yield part[x], j[y]
            continue
        point = np.uint64(VANTAGE[0][level] | VANTAGE[1][level] << HALF)
        da, db = np.bitwise_count(a[i] ^ point).astype(int), np.bitwise_count(b[j] ^ point).astype(int)
        for d in np.unique(da):
            near = j[np.abs(db - d) <= radius]
            if len(near):
                todo.append((i[da == d], near, level + 1))


def star(left: np.ndarray, right: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each fingerprint, to the smallest of those it is connected with here: no group is written out as pairs."""
    values, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = where[: len(left)], where[len(left):]
    label = np.arange(len(values))
    for i, j in pairs:
        x, y = a[i], b[j]
        while len(x):
            lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            apart = lo != hi
            x, y = x[apart], y[apart]
            if not len(x):
                break
            np.minimum.at(label, hi[apart], lo[apart])
            while (label != label[label]).any():
                label = label[label]
    linked = label != np.arange(len(values))
    return values[linked], values[label[linked]]


def links(fps: DataFrame, radius: int = 3, block: int = 8192, parts: int = 2) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all those within `radius` bits; fps has each fingerprint once. `parts`: a key of TREES.

    The number of levels follows the number of fingerprints. A shard of more than `block` members is dealt over tasks as pairs of
    blocks. Each task gives one link a member at most, so a group of n fingerprints gives n links and not n * n.
    """
    n = fps.count()
    spread, most, size = TREES[parts]
    levels = min(most, max(1, math.ceil(math.log(max(n, 1) / size, spread)))) if n > size else 1
    members = shards(fps, levels, radius, parts)
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"))
    k = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    large = written(sizes.filter(F.col("n") > block).select("shard", k.alias("k")), "large-shards")
    members = (members.join(large, "shard", "left").withColumn("k", F.coalesce("k", F.lit(1)))
               .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
               .select("shard", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "home", "fp"))

    def run(t: pa.Table) -> pa.Table:
        fp, home, own = (t.column(c).to_numpy() for c in ("fp", "home", "own"))
        fp, x, y = fp.view(np.uint64), t.column("x")[0].as_py(), t.column("y")[0].as_py()
        if x == y:
            sides = [(fp[home], fp)]
        else:
            sides = [(fp[home & (own == x)], fp[own == y]), (fp[home & (own == y)], fp[~home & (own == x)])]
        out = [star(p, q, near_pairs(p, q, radius, levels)) for p, q in sides]
        a, b = (np.concatenate([o[i] for o in out]).view(np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return members.groupBy("shard", "x", "y").applyInArrow(run, "a long, b long")


def groups(rows: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) of rows (doc_id, fp): the smallest doc_id of all documents that chains of near fingerprints reach.

    Equal fingerprints are one node, so copies of a document, however many, cost one row after the first aggregation.
    """
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    root = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    member = written(distinct.join(root, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "members")
    lowest = written(member.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    return written(member.join(lowest, "root").select("fp", "component_id"), "groups")


def near_duplicates(documents: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents.

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id reachable over links of `radius` differing bits or
    less, itself included. Null or empty text: fingerprint zero, linked like any other. Fewer than three words: one shingle.
    Repeated rows each get a row. A null doc_id takes part but never names a component unless all its members have none.
    No rows: none. Other columns are left out.
    """
    rows = written(fingerprints(documents, "doc_id"), "fp-rows")
    found = rows.join(groups(rows, radius), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = 3) -> DataFrame:
    """documents with one row of each component left, the one with the smallest doc_id (of several, the first in the input)."""
    placed = documents.withColumn("__place", F.monotonically_increasing_id())
    rows = written(fingerprints(placed, "doc_id", "__place"), "fp-rows")
    named = rows.join(groups(rows, radius), "fp")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__place"))
    marked = written(named.select("__place", "component_id", "fp", order.alias("order")), "named")
    first = written(marked.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
                    .agg(F.min("order").alias("order")).select(F.col("order.__place").alias("__place")), "first")
    others = written(marked.select("__place").join(first, "__place", "left_anti"), "others")
    return placed.join(small(others), "__place", "left_anti").drop("__place")

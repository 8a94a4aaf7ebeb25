"""Nearest neighbours: rows sharded by a vantage-point tree, each shard searched through a tree of its own."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.common import written


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences."""
    out = np.empty((len(a), len(b)))
    for at in range(0, len(a), 32):
        d = a[at:at + 32, None, :] - b[None, :, :]
        out[at:at + 32] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


@dataclass
class Node:
    """A leaf holds rows; another node a vantage point, and the distance at which its rows are split in two halves."""
    rows: np.ndarray | None = None
    point: np.ndarray | None = None
    split: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def build(x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> Node:
    if len(rows) <= leaf:
        return Node(rows)
    point = x[rows[rng.integers(len(rows))]]
    d = distances(point[None], x[rows])[0]
    split = float(np.median(d))
    near = d <= split
    if near.all():  # nothing but ties: split as they lie, at a distance that bounds nothing
        half = len(rows) // 2
        return Node(None, point, math.nan, build(x, rows[:half], leaf, rng), build(x, rows[half:], leaf, rng))
    return Node(None, point, split, build(x, rows[near], leaf, rng), build(x, rows[~near], leaf, rng))


def leaves(node: Node, queries: np.ndarray, bound: np.ndarray, factor: float) -> Iterator[tuple[Node, np.ndarray]]:
    """Each leaf with the places of the queries that reach it. A branch is cut where the triangle inequality puts all its rows
    beyond factor * bound: 1 cuts only what can't hold a nearer row, less cuts more. bound may shrink meanwhile."""
    todo = [(node, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        node, active, least = todo.pop()
        go = least <= factor * bound[active]
        active, least = active[go], least[go]
        if not len(active):
            continue
        if node.rows is not None:
            yield node, active
            continue
        gap = distances(queries[active], node.point[None])[:, 0] - node.split
        gap = np.where(np.isnan(gap), 0.0, gap) * (1 - 1e-12)
        todo.append((node.outside, active, np.maximum(least, -gap)))
        todo.append((node.inside, active, np.maximum(least, gap)))


class Best:
    """The k nearest (distance, id) of each query so far, ties to the smaller id, and the distance that a better row must not exceed."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.queries, self.own, self.bound, self.k = queries, own, bound.copy(), k
        self.far = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, active: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        d = distances(self.queries[active], x)
        d[ids[None, :] == self.own[active][:, None]] = np.inf
        far = np.concatenate([self.far[active], d], axis=1)
        every = np.concatenate([self.ids[active], np.broadcast_to(ids, d.shape)], axis=1)
        order = np.lexsort((every, far), axis=1)[:, : self.k]
        self.far[active], self.ids[active] = np.take_along_axis(far, order, 1), np.take_along_axis(every, order, 1)
        self.bound[active] = np.minimum(self.bound[active], self.far[active, self.k - 1])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not all zero, nothing in it null or not finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def shard_of(root: Node, leaf_numbers: dict[int, int], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if node.rows is not None:
            out[at] = leaf_numbers[id(node)]
        elif len(at):
            near = distances(x[at], node.point[None])[:, 0] <= node.split
            todo += [(node.inside, at[near]), (node.outside, at[~near])]
    return out


def number(root: Node) -> dict[int, int]:
    out: dict[int, int] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.rows is not None:
            out[id(node)] = len(out)
        else:
            todo += [node.outside, node.inside]
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, sample: int = 2048, shard_rows: int = 8192,
            leaf: int = 128, block: int = 256, asked_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each query by Euclidean distance, nearest first, ties to the smaller vec_id.

    rows and queries are (vec_id, embedding); a query never finds its own vec_id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do those of another length than the sample's. Fewer rows than k: all of them. Of equal
    vectors only the k + 1 smallest ids can be results, so only those are indexed: a vector held by a third of all rows costs no more
    than another. No usable rows: none.

    A vantage-point tree over a fixed number of rows (`sample`, those of the smallest hashed ids) cuts the space into shards; every row goes to
    the shard it lies in, shards of more than shard_rows rows are dealt over several tasks, as are blocks of asked_rows queries, and each
    task builds a tree of its own.
    A query goes, in blocks, to the shards that the triangle inequality doesn't rule out: its k-th nearest sampled row bounds its
    k-th nearest row. factor relaxes the bounds: 1 is exact search, less visits fewer branches. Recall is a test's business.
    """
    def clean(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        return df.filter(usable(vector) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("x"))

    data = written(clean(rows).distinct(), "vectors")
    first = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    width = max(first.x.map(len), default=0)
    first = first[first.x.map(len) == width]
    fitted, ids = np.array(first.x.tolist(), np.float64).reshape(len(first), width), first.vec_id.to_numpy(np.int64)
    by_vector = Window.partitionBy("x").orderBy("vec_id")
    data = data.filter(F.size("x") == width)
    held = data.withColumn("copy", F.row_number().over(by_vector)).filter(F.col("copy") <= k + 1).drop("copy")
    shards = max(1, 2 ** max(0, math.ceil(math.log2(max(1, data.count()) / shard_rows))))
    root = build(fitted, np.arange(len(fitted)), max(1, math.ceil(len(fitted) / shards)), np.random.default_rng(0))
    numbers = number(root)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((root, numbers, fitted, ids))  # at most `sample` vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, _, _, _ = shared.value
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(root, number(root), x)), *b.columns], ["shard", "vec_id", "x"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, _, fitted, ids = shared.value
        names = number(root)
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                x = np.array(part.column("x").to_pylist(), np.float64).reshape(part.num_rows, width)
                best = Best(x, part.column("vec_id").to_numpy(), np.full(len(x), np.inf), k)
                best.offer(np.arange(len(x)), fitted, ids)
                goal = best.bound.copy()
                for node, active in leaves(root, x, goal, factor):
                    to = pa.array(np.full(len(active), names[id(node)], np.int32))
                    yield pa.RecordBatch.from_arrays([to, *part.take(pa.array(active)).columns, pa.array(goal[active])], ["shard", "vec_id", "x", "bound"])

    placed = written(held.mapInArrow(place, "shard int, vec_id long, x array<double>"), "placed")
    parts = placed.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).cast("int").alias("parts"))
    table = written(parts, "shards")  # one row a shard, and there are no more shards than sampled rows
    asked = clean(queries).filter(F.size("x") == width).mapInArrow(route, "shard int, vec_id long, x array<double>, bound double")
    asked_blocks = max(1, math.ceil(queries.count() / asked_rows))
    left = (placed.join(F.broadcast(table), "shard").withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))
            .select("shard", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "asked", "vec_id", "x"))
    right = (asked.join(F.broadcast(table), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("shard", "part", F.pmod(F.xxhash64("vec_id"), F.lit(asked_blocks)).cast("int").alias("asked"), "vec_id", "x", "bound"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pd.DataFrame] = []
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("vec_id").to_numpy())
            x, own = np.array(left.column("x").to_pylist(), np.float64)[order], left.column("vec_id").to_numpy()[order]
            tree = build(x, np.arange(len(x)), leaf, np.random.default_rng(1))
            for at in range(0, right.num_rows, block):
                part = right.slice(at, block)
                q = np.array(part.column("x").to_pylist(), np.float64)
                best = Best(q, part.column("vec_id").to_numpy(), part.column("bound").to_numpy(), k)
                for node, active in leaves(tree, q, best.bound, factor):
                    best.offer(active, x[node.rows], own[node.rows])
                i, j = np.nonzero(np.isfinite(best.far))
                out.append(pd.DataFrame({"query_id": best.own[i], "vec_id": best.ids[i, j], "score": best.far[i, j]}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pa.Table.from_pandas(found, preserve_index=False)

    cell = ["shard", "part", "asked"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

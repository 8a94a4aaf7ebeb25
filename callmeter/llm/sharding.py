"""Sharding by jump consistent hashing, with gapless slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.common import written

#: Fixed values of jump consistent hashing: the multiplier of its generator.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among `shards`: about ln(shards) rounds, no table; appending shards only moves rows into them."""
    key, last, nxt = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    go = np.arange(len(keys))
    while len(go):
        last[go] = nxt[go]
        key[go] = key[go] * np.uint64(MULTIPLIER) + np.uint64(1)
        nxt[go] = ((last[go] + 1) * (2.0**31 / ((key[go] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        go = go[nxt[go] < shards]
    return last


def jump_column(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in batches:
            yield pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards))

    return shard(key)


def slots(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `slot`: gapless from 0 in each value of `group`, in `order`; rows that tie in it go by their place in the input.

    Rows are dealt by ranges of (order, place), so no value of any column can fill a task, and numbered inside each
    range; one count per range and group gives the offsets.
    """
    placed = written(rows.withColumn("__place", F.monotonically_increasing_id()), "placed")
    ranged = written(placed.repartitionByRange(*order, "__place").sortWithinPartitions(*order, "__place")
                     .withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)), "ranged")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("__range", group).agg(F.count("*").alias("__n"))
               .select("__range", group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    inside = F.row_number().over(Window.partitionBy("__range", group).orderBy("__at"))
    return (ranged.withColumn("__slot", inside).join(offsets, ["__range", group])
            .withColumn("slot", (F.col("__offset") + F.col("__slot") - 1).cast("long"))
            .drop("__place", "__at", "__range", "__slot", "__offset"))


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Documents over `shards` by the law `key`: doc_id and the number of shards alone decide.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law, shard, slot and grown_shard, the shard
    once one more is appended. The key is doc_id as an unsigned number; a null doc_id counts as key 2**64-1. Repeated
    rows share a shard and get slots of their own, in order of doc_id (nulls first), checksum and place. Empty text: size 1,
    checksum 0. No rows: none. Other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                            F.lit("key").alias("law"), jump_column(key, shards).alias("shard"), jump_column(key, shards + 1).alias("grown_shard"))
    return slots(rows, "shard", ["doc_id", "text_crc32"])

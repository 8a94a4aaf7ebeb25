"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.session import scratch_path

#: White space that separates words and is stripped from lines: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders of the columns `by`: computed once, with its lineage cut, and readable after any executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count shows at most so many rows, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` does the same, faster, where every character is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has texts go to Python in batches of so many rows, where the session still has Spark's default of 10,000, made for rows of numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives memory that is free again back to the system: a reused Python worker else holds the peak of every job it served."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not with every C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most so many rows, so that what is made of a slice is gone before the next; memory is released at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    release()

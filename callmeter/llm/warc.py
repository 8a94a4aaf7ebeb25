"""Fixity of web archives: Merkle trees over records and ordered offset ranges, compared from the root down."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmeter.llm.common import written
from callmeter.llm.sharding import slots

#: Bytes of an archive that a node of each level covers; above the last, a node covers a whole file.
RANGES = (1 << 16, 1 << 20, 1 << 24, 1 << 28)
#: Fixed value of the records: pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC/1.1 resource record. Null url and html are empty; a null page_id is named `null`."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def page_leaves(pages: DataFrame, per_file: int = 1000, kept: Column | None = None, stored: Column | None = None) -> DataFrame:
    """(warc_file, offset, length, page_id, sha256) of the records of pages, laid out in order of page_id, per_file to a file.

    Only lengths and hashes are shuffled, never the pages. For a replica: `kept` says which records it has and `stored` what it holds
    in the place of a record (columns of page_id and `record`). Repeated pages are records of their own, in the order of the input.
    """
    whole = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    held = F.col("record") if stored is None else stored
    rows = whole.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(held.cast("binary"), 256).alias("sha256"),
                        (F.lit(True) if kept is None else F.coalesce(kept, F.lit(True))).alias("kept"))
    at = slots(rows.withColumn("archive", F.lit(0)), "archive", ["page_id"]).withColumn("warc_file", F.floor(F.col("slot") / per_file).cast("long"))
    before = Window.partitionBy("warc_file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = at.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.filter("kept").select("warc_file", "offset", "length", "page_id", "sha256")


def records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an uncompressed WARC file; bytes that begin no record, or a cut-off end, come as one last piece."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        size = _LENGTH.search(content, at, head) if head >= 0 and content.startswith(b"WARC/", at) else None
        end = head + 8 + int(size[1]) if size else len(content)
        yield at, content[at:end]
        at = end


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(warc_file, offset, length, sha256) of the records in the WARC files under path, in its folders too, .gz or not; warc_file is the path below it without .gz.

    A file is read as one value, so those of 2 GB and more have to be split first.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                found = [(o, len(r), hashlib.sha256(r).hexdigest()) for o, r in records(data)]
                offsets, lengths, hashes = (list(c) for c in zip(*found)) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), pa.string()), pa.array(offsets, pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array(hashes, pa.string())], ["warc_file", "offset", "length", "sha256"])

    def bare(c: Column) -> Column:  # without scheme and host
        return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")

    top, whole = bare(F.lit(path.rstrip("/"))), bare(F.col("path"))
    name = F.when(whole.startswith(F.concat(top, F.lit("/"))), F.substr(whole, F.char_length(top) + 2)).otherwise(F.regexp_extract(whole, r"([^/]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return (files.select(F.regexp_replace(name, r"\.gz$", "").alias("name"), "content")
            .mapInArrow(run, "warc_file string, offset long, length long, sha256 string"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels of a replica's trees, leaves first: (warc_file, place, hash), then (warc_file, hash) of the roots.

    A leaf's place is its offset, a node's the number of its range. A node hashes the places and hashes of its children in order, at most
    sixteen ranges or the records that begin in 64 KB. Several records at one offset are one leaf: the hash of all their hashes in order, each with
    how often it is there.
    """
    each = leaves.groupBy("warc_file", F.col("offset").alias("place"), F.coalesce("sha256", F.lit("")).alias("sha256")).agg(
        F.count("*").alias("n"), F.max("length").alias("length"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("sha256", "n"))), lambda c: F.concat_ws(":", c["sha256"], c["n"].cast("string")))
    base = each.groupBy("warc_file", "place").agg(
        F.when(F.sum("n") == 1, F.min("sha256")).otherwise(F.sha2(F.array_join(held, ","), 256)).alias("hash"), F.max("length").alias("length"))
    out = [written(base, "merkle-0")]
    under = 1
    for size in RANGES:
        out.append(written(_above(out[-1], F.floor(F.col("place") / (size // under)).cast("long")), f"merkle-{len(out)}"))
        under = size
    out.append(written(_above(out[-1], F.lit(0).cast("long")), "merkle-roots"))
    return out


def _above(level: DataFrame, place: Column) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("place", "hash")))
    text = F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"])))
    return level.groupBy("warc_file", place.alias("above")).agg(F.sha2(text, 256).alias("hash")).withColumnRenamed("above", "place")


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(warc_file, offset, length, fault, expected_sha256, found_sha256) for each record in which two replicas differ.

    Both are leaves (warc_file, offset, length, sha256). fault: changed, missing (found has none there) or extra. The roots are compared
    first, and of each level only the children of nodes that differ: sound branches are never read. Equal replicas, empty ones too:
    no rows. Null file names are one file; a null sha256 is an empty one.
    """
    a, b = tree(expected), tree(found)
    suspects = None
    sizes = [1, *RANGES]
    for level in range(len(a) - 1, -1, -1):
        sides = []
        for t in (a, b):
            nodes = t[level]
            if suspects is not None:
                up = F.lit(0).cast("long") if level == len(a) - 2 else F.floor(F.col("place") / (sizes[level + 1] // sizes[level])).cast("long")
                s = suspects.select(F.col("warc_file").alias("f"), F.col("place").alias("p"))
                nodes = nodes.join(s, nodes["warc_file"].eqNullSafe(s["f"]) & (up == s["p"]), "left_semi")
            sides.append(nodes)
        x, y = sides[0].alias("x"), sides[1].alias("y")
        both = x.join(y, F.col("x.warc_file").eqNullSafe(F.col("y.warc_file")) & (F.col("x.place") == F.col("y.place")), "full")
        apart = both.filter(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        first = [F.when(F.col("x.hash").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in ("warc_file", "place")]
        if level:
            suspects = written(apart.select(*first), "suspects")
    fault = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("changed")
    return apart.select(first[0], first[1].alias("offset"), F.coalesce("x.length", "y.length").alias("length"), fault.alias("fault"),
                        F.col("x.hash").alias("expected_sha256"), F.col("y.hash").alias("found_sha256"))

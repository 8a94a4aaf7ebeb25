"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.llm.common import SPACES, ascii_lower, written

#: doc_id under which all rows without one count as a single document, below every other.
NO_ID = -(2**63)
#: Most places of dropped lines, and ids of their documents, that may be broadcast; beyond, they are joined by a shuffle of the texts.
BROADCAST_PLACES = 2_000_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> list[Column]:
    """128 bits of a key: two XXH64 of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def keyed_lines(documents: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc, row, pos, h1, h2) for each line whose key has min_chars code points; row tells apart rows of one doc_id."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    row = F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")
    lines = documents.select(doc, row, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return (lines.filter(F.char_length(F.btrim("line", F.lit(SPACES))) >= min_chars)
            .select("doc", "row", "pos", *hashes(line_key(F.col("line")))))


class LineRuns:
    """Runs of (h1, h2, n_docs, keeper) sorted by hash, in levels: `fanout` runs of a level are merged into one of the next.

    A batch holds all lines of its documents, so the documents of different runs differ and their counts add up.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        return (reduce(DataFrame.union, runs).groupBy("h1", "h2")
                .agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")))

    def _sorted(self, run: DataFrame, label: str) -> DataFrame:
        return written(run.sortWithinPartitions("h1", "h2"), label)

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch that no run holds yet: a merge anti-join with each run (what first-come dedup keeps)."""
        return reduce(lambda left, run: left.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti"), self.runs(), lines)

    def add(self, lines: DataFrame) -> None:
        """Adds the run of a batch and compacts every level that is full."""
        docs = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        run = docs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        self.levels[0].append(self._sorted(run, "run-0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._sorted(self._merge(self.levels[level]), f"run-{level + 1}"))
            self.levels[level] = []
            level += 1

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the keys found in min_docs documents or more; keeper is the largest doc_id."""
        runs = self.runs()
        merged = runs[0] if len(runs) == 1 else self._merge(runs)
        return merged.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def dropped_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """(doc, row, dropped): for each document row that loses lines, their places, from 0. Batches are dealt by doc_id."""
    spark = documents.sparkSession
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch")
    lines = written(keyed_lines(documents, min_chars).select("*", batch), "lines")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    repeated = written(runs.repeated(min_docs), "repeated")
    lost = lines.join(repeated, ["h1", "h2"]).filter(F.col("doc") != F.col("keeper")).select("doc", "row", "pos")
    return lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(documents: DataFrame, **options: int) -> DataFrame:
    """documents with the lines that repeat across documents taken out of `text`; see `drop_columns` for the added columns.

    A line's key is the line stripped of white space, with A-Z in lower case. Keys of min_chars code points found in min_docs
    documents lose all their lines except those in the largest doc_id that holds them. The other lines stay as they are, joined by a
    line feed. Null text is an empty one: one empty line. Rows of one doc_id are one document; rows without doc_id are
    one document below all others. Repeated rows are each treated alike. No rows: none. Extra columns stay.
    """
    return with_kept(documents, **options).drop("__lines", "__dropped")


def with_kept(documents: DataFrame, **options: int) -> DataFrame:
    """documents with `text` deduplicated, and `__lines` (how many before) and `__dropped` (places of dropped lines)."""
    found = written(dropped_lines(documents, **options), "lost")
    places = found.agg(F.sum(F.size("dropped") + 2).alias("n")).first().n or 0
    lost = (F.broadcast(found) if places <= BROADCAST_PLACES else found).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("dropped").alias("__lost"))
    keyed = documents.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__row": F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = keyed.join(lost, ["__doc", "__row"], "left").withColumn("__all", split_lines(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__all", i)), "\n"))
    return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in documents.columns], F.size("__all").cast("long").alias("__lines"),
                         F.coalesce(F.col("__lost"), F.array().cast("array<int>")).alias("__dropped"))


def digest(documents: DataFrame, **options: int) -> DataFrame:
    d = with_kept(documents, **options)
    return d.select("doc_id", F.col("__lines").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"),
                    F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))

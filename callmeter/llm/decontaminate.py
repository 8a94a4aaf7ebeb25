"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import SPACES, small, written

SHINGLE, BLOCKS, BLOCK_BITS = 5, 8, 8


def words_of(text: Column) -> Column:
    """The words of a text in lower case; none: one empty word, which no item holds."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES)), "[ \\t-\\r]+", -1)


def _shingle(words: str, start: str, length: str) -> str:
    return f"xxhash64(concat_ws(' ', slice({words}, {start} + 1, {length})))"


def shingles(words: str) -> Column:
    """Hashes of the five-word shingles of an array of words, repeats included; fewer words are one shingle."""
    return F.expr(f"transform(sequence(0, greatest(size({words}) - {SHINGLE}, 0)), i -> {_shingle(words, 'i', str(SHINGLE))})")


def simhash(hashes: str) -> Column:
    """A bit is set if it is in over half of the hashes."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + CAST(shiftright(h, b) & 1 AS INT))"
    return F.expr(f"aggregate(transform(sequence(0, 63), b -> IF(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)")


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes; a shingle weighs as often as it occurs."""
    shared = f"aggregate(transform(array_distinct({a}), x -> least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))), 0, (n, m) -> n + m)"
    return F.expr(f"{shared} / CAST(size({a}) + size({b}) - {shared} AS DOUBLE)")


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, n, hashes, fp) of the items that have words; equal rows are one item. item is a number of its own, as item_id may be null."""
    items = (benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter("words[0] <> ''").distinct()
             .withColumn("hashes", shingles("words")))
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "words", F.size("words").alias("n"), "hashes", simhash("hashes").alias("fp"))


def anchors(items: DataFrame) -> DataFrame:
    """(word, back, size, hash, item, n, at): for each shingle of an item, its longest word, which stands `back` words after the shingle's start."""
    each = items.select("item", "n", "words", F.posexplode("hashes").alias("at", "hash")).withColumn("own", F.expr(f"slice(words, at + 1, {SHINGLE})"))
    longest = F.expr("array_max(transform(own, (w, i) -> struct(char_length(w) AS chars, w AS word, -i AS place)))")
    return (each.select("item", "n", "at", "hash", F.size("own").alias("size"), longest.alias("top"))
            .select(F.col("top.word").alias("word"), (-F.col("top.place")).alias("back"), "size", "hash", "item", "n", "at"))


def shared_windows(rows: DataFrame, items: DataFrame, bound: int, least: float) -> DataFrame:
    """(place, n, start) of the item-sized windows of rows (place, words), at any start, that share enough shingles with an item of that size.

    A window that the text's end cuts is taken from the smallest to the largest start at which a shared shingle lies as in the item.
    One of similarity `least` holds at least that part of the item's shingles, so windows with fewer places of shared shingles are left out and no
    other is. Few items: their shingles' longest words
    are looked up among the words of each text, without a shuffle. Many: all shingles of the texts, and those of the lengths of the
    items of fewer words, are joined by hash.
    """
    keys = written(anchors(items), "anchors")
    table = small(keys, bound)
    if table is keys:
        sizes = [r["size"] for r in keys.select("size").distinct().collect()]  # five at most
        own = [f"IF(size(words) < {c}, array(), transform(sequence(0, greatest(size(words) - {c}, 0)), i -> struct({c} AS size, i AS first, {_shingle('words', 'i', str(c))} AS hash)))"
               for c in sizes] or ["array(struct(0 AS size, 0 AS first, 0L AS hash))"]
        each = rows.select("place", F.size("words").alias("w"), F.explode(F.expr(f"concat({', '.join(own)})")).alias("s")).select("place", "w", "s.*")
        hits = each.join(keys, ["size", "hash"]).select("place", "w", "item", "n", "at", "first")
    else:
        each = rows.select("place", "words", F.posexplode("words").alias("pos", "word"))
        first = "pos - back"
        hits = (each.join(table, "word").filter(f"{first} >= 0 AND {first} + size <= size(words)")
                .filter(f"{_shingle('words', first, 'size')} = hash").select("place", F.size("words").alias("w"), "item", "n", "at", F.expr(first).alias("first")))
    held = hits.groupBy("place", "w", "item", "n").agg(F.array_sort(F.collect_set("first")).alias("p"),
                                                       F.min(F.expr("first - at")).alias("lo"), F.max(F.expr("first - at")).alias("hi"))
    held = held.withColumn("m", F.greatest(F.col("n") - SHINGLE + 1, F.lit(1))).withColumn("k", F.expr(f"CAST(greatest(ceil({least} * CAST(m AS DOUBLE) - 1e-9), 1) AS INT)"))
    close = "filter(sequence(0, size(p) - k), i -> p[i + k - 1] - m < p[i])"
    starts = F.expr(f"flatten(transform({close}, i -> sequence(greatest(p[i + k - 1] - m + 1, 0), p[i])))")
    laid = held.filter("size(p) >= k").select("place", "w", "n", "lo", "hi", F.explode(starts).alias("start"))
    return laid.filter("start + n <= w OR start BETWEEN greatest(lo, 0) AND greatest(hi, 0)").select("place", "n", "start").distinct()


def blocks(fp: str, flips: int = 0) -> Column:
    """(block, value) of a fingerprint, with every value that up to `flips` changed bits of a block make."""
    masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BLOCK_BITS), k)]
    value = f"shiftrightunsigned({fp}, {BLOCK_BITS} * i) & {(1 << BLOCK_BITS) - 1}L"
    return F.expr(f"flatten(transform(sequence(0, {BLOCKS - 1}), i -> transform(array({', '.join(f'{m}L' for m in masks)}), m -> struct(i AS block, ({value}) ^ m AS value))))")


def leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 20, bound: int = 200_000) -> DataFrame:
    """(place, doc_id, item_id, start, length, similarity): the best window of each document row for each item that it holds.

    place numbers the rows of documents as they lie. A window has as many words as the item; it is a leak if the weighted similarity of their
    five-word shingles is `least` or more (items of fewer words: equal words). Windows and items are linked by SimHash:
    fingerprints of `radius` differing bits or less agree in one of eight blocks up to radius // 8 bits, so looking up these values
    finds all of them; then the similarity itself is taken. `bound`: most item shingles that are broadcast.
    Null and empty texts hold nothing, on either side. Repeated rows are each reported. No rows on a side: none.
    """
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("place"), words_of(F.col("text")).alias("words"))
    items = written(item_table(benchmark), "items")
    found = written(shared_windows(rows, items, bound, least), "windows")
    wanted = found.groupBy("place").agg(F.collect_set(F.struct("n", "start")).alias("wanted"))
    cut = (rows.join(small(written(wanted, "wanted"), bound), "place").select("place", "doc_id", "words", F.explode("wanted").alias("w"))
           .select("place", "doc_id", "w.n", "w.start", F.expr("slice(words, w.start + 1, w.n)").alias("own")).withColumn("hashes", shingles("own")))
    windows = written(cut.select("place", "doc_id", "n", "start", "hashes"), "window-shingles").withColumn("fp", simhash("hashes"))
    index = items.select("item", "n", F.col("fp").alias("item_fp"), F.explode(blocks("fp", radius // BLOCKS)).alias("b")).select("item", "n", "item_fp", "b.*")
    looked = windows.select("place", "start", "n", "fp", F.explode(blocks("fp")).alias("b")).select("place", "start", "n", "fp", "b.*")
    near = (looked.join(small(written(index, "blocks"), bound), ["n", "block", "value"])
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("place", "start", "n", "item").distinct())
    near = written(near, "near")
    held = items.select("item", "item_id", F.col("hashes").alias("item_hashes"))
    sure = (near.join(windows.drop("fp"), ["place", "start", "n"]).join(small(held, bound), "item")
            .withColumn("similarity", similarity("hashes", "item_hashes")).filter(F.col("similarity") >= least))
    best = F.min_by(F.struct("start", "n", "similarity"), F.struct(-F.col("similarity"), "start"))
    return (sure.groupBy("place", "item_id").agg(F.first("doc_id").alias("doc_id"), best.alias("best"))
            .select("place", "doc_id", "item_id", F.col("best.start").alias("start"), F.col("best.n").alias("length"), F.col("best.similarity").alias("similarity")))


def clean(documents: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """documents without the rows that hold an item of the benchmark; all columns stay."""
    found = written(leaks(documents, benchmark, **options).select(F.col("place").alias("__place")).distinct(), "leaks")
    return documents.withColumn("__place", F.monotonically_increasing_id()).join(small(found), "__place", "left_anti").drop("__place")

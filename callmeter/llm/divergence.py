"""Divergence audit: how far the words of each source of a language are from those of its other sources and of the language."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.common import release, slices, small, text_batches, written
from callmeter.session import scratch_path

#: Terms are all but control characters, punctuation, digits and white space of ASCII, which become spaces here; A-Z in lower case. Bytes of
#: 0x80 and more belong to characters beyond ASCII.
LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
#: Stands between the language and the term; no term holds it.
MARK = "\x00"
SCALE = 1_000_000_000
#: The greatest vocabSize there is: no vocabulary is cut.
EVERY_TERM = 2**31 - 1
#: Pairs of sources that share a term, looked at at once.
BLOCK = 1 << 20
#: Bytes of the vocabulary of a bucket of terms.
BUCKET_BYTES = 8_000_000
#: Terms of documents, and bytes of their texts, that are folded at once; most terms of a row.
FOLD_TERMS, FOLD_BYTES, ROW_TERMS = 1 << 21, 1 << 26, 1 << 16
#: Hashes by which folded terms are dealt (more for a table of over 8 * HOMES splits); bytes of a part, some of these hashes, that is folded again; the
#: fewest parts. As many buckets as parts need no other pass.
HOMES, PART_BYTES, LEAST_PARTS = 256, 12_000_000, 8


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of any size; decimals only where a long would overflow."""
    over, under = F.lit(SCALE).cast("decimal(18,0)") * (count + 1).cast("decimal(19,0)"), total + terms
    exact = F.when(count < 2**63 // SCALE - 1, F.call_function("div", F.lit(SCALE).cast("long") * (count + 1).cast("long"), under.cast("long")))
    return F.when(terms > 0, exact.otherwise(F.call_function("div", over, under.cast("decimal(19,0)"))) + 1).cast("long")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


class _Ids(dict):
    """Numbers terms in order of appearance and notes each in `names`, and `own` in `of`."""

    def __init__(self, own: int, names: list[bytes], of: array) -> None:
        self.own, self.names, self.of = own, names, of

    def __missing__(self, term: bytes) -> int:
        i = self[term] = len(self.names)
        self.names.append(term)
        self.of.append(self.own)
        return i


def _starts(key: np.ndarray) -> np.ndarray:
    """Where in sorted keys a new one begins."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _added(group: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, term and the sum of the counts, each group and term once."""
    key = group.astype(np.int64) * terms + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = _starts(key)
    return key[first] // terms, key[first] % terms, np.add.reduceat(count[order].astype(np.int64), first)


class _Fold:
    """What documents hold between them, until `rows` hands it over: per group and term the count, per term the number of documents."""

    def __init__(self, homes: int) -> None:
        self.homes, self.names, self.of_lang, self.langs = homes, [], array("i"), []
        self.known: dict[str, _Ids] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.ids, self.counts, self.lengths, self.of = array("i"), array("i"), array("i"), array("i")
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = _Ids(len(self.langs), self.names, self.of_lang)
            self.langs.append(lang)
        found = Counter(text.translate(LETTERS).split())
        self.ids.extend(map(self.known[lang].__getitem__, found))
        self.counts.extend(found.values())
        self.lengths.append(len(found))
        self.of.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= FOLD_TERMS or self.bytes >= FOLD_BYTES

    def rows(self, min_df: int) -> Iterator[pa.RecordBatch]:
        """A row for each language and home (a hash of the term): the terms with a space between, for each the number of documents (min_df at
        most), and the counts as three lists: places in `sources`, places among the terms, counts. Numbers are packed, so that no engine takes them apart."""
        ids, counts = np.array(self.ids, np.int64), np.array(self.counts, np.int64)
        if not len(ids):
            return
        n, sources = len(self.names), [g[1] for g in self.groups]
        df = np.minimum(np.bincount(ids, minlength=n), min_df).astype(np.int64)
        group, term, total = _added(np.repeat(np.array(self.of, np.int64), np.array(self.lengths, np.int64)), ids, counts, n)
        box = np.fromiter(map(crc32, self.names), np.int64, n) % self.homes + np.array(self.of_lang, np.int64) * self.homes
        by_box = np.argsort(box, kind="stable")
        start = _starts(box[by_box])
        place = np.empty(n, np.int64)
        place[by_box] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        order = np.argsort(box[term], kind="stable")
        group, total, held, place = group[order], total[order], box[term[order]], place[term[order]]
        cells = _starts(held)  # every term has a count, so boxes of terms and of counts are the same
        out: list[tuple] = []
        for lo, hi, x, y in zip(start, np.append(start[1:], n), cells, np.append(cells[1:], len(held))):
            own, at = np.unique(group[x:y], return_inverse=True)
            terms = by_box[lo:hi]
            out.append((int(held[x] % self.homes), self.langs[held[x] // self.homes], b" ".join([self.names[t] for t in terms]), df[terms].tobytes(),
                        [sources[g] for g in own], at.astype(np.int32).tobytes(), place[x:y].astype(np.int32).tobytes(), total[x:y].tobytes()))
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
        for lo in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo:lo + 200]), kinds)], FOLD_COLUMNS)


FOLD_COLUMNS = ["home", "lang", "names", "docs", "sources", "source_at", "term_at", "counts"]
FOLD_SCHEMA = "home int, lang string, names binary, docs binary, sources array<string>, source_at binary, term_at binary, counts binary"


def merged(folds: pa.Table, min_df: int) -> pa.Table:
    """Rows (lang, source, terms, weight, bytes, home) of all folds' rows of a part of the terms, each term with its language in front.

    Without weight, those of k up to min_df have the terms of k documents or more, so that a term is in as many of them as in documents, or in
    min_df; bytes has those of the terms of min_df documents. With weight d * 16 ** i, they have the terms whose count in the group has d as
    digit i; terms of fewer documents, which no vocabulary has, are left out.
    """
    names, of_lang, langs, known, groups = [], array("i"), [], {}, {}
    ids, docs, group, term, count = ([np.zeros(0, np.int64)] for _ in range(5))
    for batch in folds.to_batches():
        get = batch.column
        for k, lang in enumerate(get("lang").to_pylist()):
            if lang not in known:
                known[lang] = _Ids(len(langs), names, of_lang)
                langs.append(lang)
            own = np.fromiter(map(known[lang].__getitem__, get("names")[k].as_py().split()), np.int64)
            of = np.array([groups.setdefault((lang, s), len(groups)) for s in get("sources")[k].as_py()], np.int64)
            ids.append(own)
            docs.append(np.frombuffer(get("docs")[k].as_buffer(), np.int64))
            group.append(of[np.frombuffer(get("source_at")[k].as_buffer(), np.int32)])
            term.append(own[np.frombuffer(get("term_at")[k].as_buffer(), np.int32)])
            count.append(np.frombuffer(get("counts")[k].as_buffer(), np.int64))
    df = np.zeros(len(names), np.int64)
    np.add.at(df, np.concatenate(ids), np.concatenate(docs))
    g, t, total = _added(np.concatenate(group), np.concatenate(term), np.concatenate(count), len(names))
    enough = df[t] >= min_df
    g, t, total = g[enough], t[enough], total[enough]
    marks = [f"{lang}{MARK}".encode() for lang in langs]
    full = pa.array([marks[k] + name for k, name in zip(of_lang, names)], pa.binary())
    levels = [(None, None, np.flatnonzero(df >= k)) for k in range(1, min(min_df, int(df.max(initial=0))) + 1)]
    wide = sum(len(marks[of_lang[i]]) + len(names[i]) for i in np.flatnonzero(df >= min_df))
    for shift in range(0, int(total.max(initial=0)).bit_length(), 4):
        digit = total >> shift & 15
        levels += [(d << shift, g[digit == d], t[digit == d]) for d in range(1, 16)]
    lang, source = (pa.array([x[i] for x in groups], pa.string()) for i in (0, 1))
    out = []
    for weight, of, terms in levels:
        if not len(terms):
            continue
        key = np.zeros(len(terms), np.int64) if of is None else of  # sorted
        start = _starts(key)
        cut = np.flatnonzero((np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))) % ROW_TERMS == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)), pa.int32()), full.take(pa.array(terms)).cast(pa.string()))
        sides = [pa.nulls(len(cut), pa.string()) if of is None else x.take(pa.array(key[cut])) for x in (lang, source)]
        size = np.zeros(len(cut), np.int64)
        if not out:
            size[0] = wide
        out.append(pa.table([*sides, lists, pa.array([weight] * len(cut), pa.int64()), pa.array(size), pa.array(np.full(len(cut), folds.column("part")[0].as_py(), np.int32))],
                            ["lang", "source", "terms", "weight", "bytes", "home"]))
    return pa.concat_tables(out)


def folded(rows: DataFrame, min_df: int) -> DataFrame:
    """Written rows (lang, source, terms, weight, bytes, home, seen) of what all documents hold between them, see `merged`; seen: without weight.

    What the documents of a task hold is folded first, then dealt by terms and folded again, so that a term or count comes once, in how many
    tasks it may be. From the rows that are `seen`, min_df finds the terms it finds in the documents; the others times
    their weight add up to the counts of each group. Both have a term once a row.
    """
    text_batches(rows.sparkSession)
    binary = rows.select("lang", "source", F.col("text").cast("binary").alias("text"))
    homes = max(HOMES, binary.rdd.getNumPartitions() // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Fold(homes)
        for batch in slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                held.add(lang, source, text.as_py())
                if held.full():
                    yield from held.rows(min_df)
                    held = _Fold(homes)
        yield from held.rows(min_df)
        del held
        release()

    def merge(t: pa.Table) -> pa.Table:
        out = merged(t, min_df)
        del t
        release()
        return out

    folds = written(binary.mapInArrow(run, FOLD_SCHEMA), "folds")
    size = folds.agg(F.sum(sum((F.octet_length(c) for c in ("names", "docs", "term_at", "counts")), F.lit(0).cast("long")))).first()[0] or 0
    parts = min(homes, max(LEAST_PARTS, -(-size // PART_BYTES)))
    dealt = folds.withColumn("part", F.pmod("home", F.lit(parts)))
    made = dealt.groupBy("part").applyInArrow(merge, "lang string, source string, terms array<string>, weight long, bytes long, home int")
    return written(made.withColumn("seen", F.col("weight").isNull()), "terms", "home", "seen")


def term_buckets(parts: DataFrame, buckets: int) -> DataFrame:
    """Written rows of parts with the column bucket: the terms of each dealt to buckets by their hash."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            terms, size = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
            home = np.fromiter((crc32(t.as_buffer()) % buckets for t in terms), np.int64, len(terms))
            key = np.repeat(np.arange(len(size)), size) * buckets + home
            order = np.argsort(key, kind="stable")
            groups, first = np.unique(key[order], return_index=True)
            row = pa.array(groups // buckets)
            dealt = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), terms.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(row), batch.column("source").take(row), dealt, batch.column("weight").take(row),
                                              batch.column("seen").take(row), pa.array((groups % buckets).astype(np.int32))],
                                             ["lang", "source", "terms", "weight", "seen", "bucket"])

    rows = parts.select("lang", "source", "terms", "weight", "seen")
    dealt = rows.mapInArrow(deal, "lang string, source string, terms array<string>, weight long, seen boolean, bucket int")
    return written(dealt, "buckets", "bucket", "seen")


def group_sums(rows: DataFrame, min_df: int = 3, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(g, term, count) of the terms that at least `min_df` documents of the language hold, where count > 0; these (lang, term); and the
    groups (lang, source, g).

    What the documents hold is folded first; CountVectorizer makes the vocabulary of it, exactly that of the documents, and sparse
    vectors, which are summed by group, sparse as they are. Terms carry their language, so one fit gives a vocabulary per language. If the
    vocabulary has more than `bucket_bytes`, what bounds it on the driver and in an executor, it is done bucket by bucket of terms.
    """
    parts = folded(rows, min_df)
    size, homes = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_distinct("home")).first()
    buckets = max(1, -(-size // bucket_bytes))
    parts = term_buckets(parts, buckets) if buckets > homes else parts.withColumn("bucket", F.pmod("home", F.lit(buckets)))
    groups = written(rows.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    spark = rows.sparkSession
    sums = spark.createDataFrame([], "g long, term string, count long")
    kept = spark.createDataFrame([], "lang string, term string")
    for bucket in range(buckets):
        part = parts.filter(F.col("bucket") == bucket)
        try:
            model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=EVERY_TERM).fit(part.filter("seen"))
        except IllegalArgumentException as e:
            if "vocabulary size should be > 0" not in str(e):
                raise
            continue  # no term of this bucket is in enough documents
        path = scratch_path(spark, "vocabulary")
        model.save(path)
        term = F.substring_index("word", MARK, -1)
        words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("at", "word")).withColumn("term", term)
        words = written(words.select("at", "term", F.substr("word", F.lit(1), F.char_length("word") - F.char_length("term") - 1).alias("lang")), "words")
        v = F.unwrap_udt("vector")
        cells = (model.transform(part.filter("not seen").join(small(groups), ["lang", "source"])).select("g", "weight", F.explode(F.arrays_zip(v["indices"].alias("at"), v["values"].alias("n"))).alias("c"))
                 .groupBy("g", F.col("c.at").alias("at")).agg(F.sum(F.col("weight") * F.col("c.n").cast("long")).alias("count")))
        sums = sums.union(written(cells.join(small(words.drop("lang")), "at").select("g", "term", "count"), "sums"))
        kept = kept.union(words.select("lang", "term"))
    return sums, kept, groups


def shared_terms(terms: DataFrame) -> DataFrame:
    """(a, b, more): for groups a and b, over the terms that both hold, what f of their own probabilities adds to f with each one's that of a
    term it does not hold. terms has a row for each term with the list `cells` of its groups (g, p, zero)."""
    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            size, cells = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
            g, p, zero = (cells.field(k).to_numpy() for k in ("g", "p", "zero"))
            groups, code = np.unique(g, return_inverse=True)
            width, start = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
            upto, lo = np.cumsum(width), 0
            while lo < len(g):  # so many cells that, each with all of its term, they make about BLOCK pairs
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, "right")))
                w = width[lo:hi]
                a = np.repeat(np.arange(lo, hi), w)
                b = np.arange(len(a)) + np.repeat(start[lo:hi] - np.cumsum(w) + w, w)
                pairs, place = np.unique(code[a] * len(groups) + code[b], return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, place, f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b]))
                yield pa.RecordBatch.from_arrays([pa.array(groups[pairs // len(groups)]), pa.array(groups[pairs % len(groups)]), pa.array(total)],
                                                 ["a", "b", "more"])
                lo = hi

    each = terms.select(F.transform("cells", lambda c: F.struct(c["g"].alias("g"), c["p"].alias("p"), c["zero"].alias("zero"))).alias("cells"))
    return each.mapInArrow(run, "a long, b long, more long").groupBy("a", "b").agg(F.sum("more").alias("more"))


def audit(documents: DataFrame, min_df: int = 3, top: int = 200, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` holds each other source of the lang and the distance to it, part `term` the `top` terms
    that the source uses more than its lang does, by their share of the distance.

    Null text, lang and source count as empty. Repeated rows are documents of their own. Ties in value go by item in UTF-8 order. A
    group without terms has its pairs all the same; a lang without kept terms has pairs of distance 0 and no terms. No rows: none. Other
    columns are left out.

    Pairs are evaluated sparsely: what a term adds where one source lacks it depends on the holder's probability alone and comes from
    counts of equal probabilities; only terms that two sources share are met pair by pair, and are summed where they lie.
    """
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sums, kept, groups = group_sums(rows, min_df, bucket_bytes)
    totals = sums.groupBy("g").agg(F.sum("count").alias("total"), F.count("*").alias("held"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    stats = groups.join(totals, "g", "left").join(terms, "lang", "left").fillna(0, ["total", "held", "kept"])
    stats = written(stats.withColumn("zero", probability(F.lit(0), F.col("total"), F.col("kept")))
                    .withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "stats")
    cells = (sums.join(small(stats), "g").withColumn("p", probability(F.col("count"), F.col("total"), F.col("kept")))
             .groupBy("lang", "term").agg(probability(F.sum("count"), F.first("lang_total"), F.first("kept")).alias("q"),
                                          F.collect_list(F.struct("g", "p", "zero")).alias("cells")))
    cells = written(cells, "cells")

    other = small(stats.select("lang", F.col("g").alias("other"), F.col("zero").alias("other_zero")))
    alike = (cells.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.g").alias("g"), F.col("c.p").alias("p")).agg(F.count("*").alias("n"))
             .join(other, "lang").filter("g <> other"))
    one_sided = alike.select(F.inline(F.array(
        F.struct(F.col("g").alias("a"), F.col("other").alias("b"), (F.col("n") * distance("p", "other_zero")).alias("more")),
        F.struct(F.col("other").alias("a"), F.col("g").alias("b"), (F.col("n") * distance("other_zero", "p")).alias("more")))))
    more = one_sided.union(shared_terms(cells)).groupBy("a", "b").agg(F.sum("more").alias("more"))
    left = stats.select("lang", "source", "kept", F.col("g").alias("a"), "held", "zero")
    right = small(stats.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("held").alias("other_held"), F.col("zero").alias("other_zero")))
    lacking = (F.col("kept") - F.col("held") - F.col("other_held")) * distance("zero", "other_zero")
    pairs = (left.join(right, "lang").filter("a <> b").join(more, ["a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(lacking + F.coalesce("more", F.lit(0)), F.lit(0)).alias("value")))
    own = cells.select(F.col("term").alias("item"), "q", F.explode("cells").alias("c")).select("c.g", "item", "c.p", "q").filter("p > q").select("g", "item", distance("p", "q").alias("value"))
    order = [F.desc("value"), "item"]
    first = own.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= top)
    named = first.join(small(stats.select("g", "lang", "source")), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).union(named)

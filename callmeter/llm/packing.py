"""Packing of documents into windows by lexical retrieval: BM25 neighbours of a seed fill its window."""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from callmeter.llm.common import release, slices, small, text_batches, written
from callmeter.llm.token_counts import STABLE

WINDOW, END, K1, B = 2048, 1, 1.2, 0.75
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


#: The control strings of the vocabulary, each one id wherever it stands in a text.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """The ids that the library `tokenizers` gives for the vocabulary, in a third of the time: ranks of the same vocabulary cut all texts
    but those with characters that Unicode versions class differently."""

    def __init__(self, ranks: str, tokenizer: str) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
        self.unstable, self.path = re.compile(f"[^{STABLE}]").search, tokenizer
        self.n_vocab = self.fast.n_vocab

    @cached_property
    def plain(self) -> Tokenizer:
        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def ids(self, text: str) -> list[int]:
        if self.unstable(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


@lru_cache(maxsize=2)
def encoder(ranks: str, tokenizer: str = TOKENIZER) -> Encoder:
    return Encoder(ranks, tokenizer)


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def tokenize(documents: DataFrame, path: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(place, doc_id, ids): the ids of each row's text and the end id, as little-endian bytes; place numbers the rows as they lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, tokenizer)
        kind = id_type(e.n_vocab)
        for b in slices(batches):
            ids = [np.array([*e.ids(t.as_py() or ""), END], kind).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["place", "doc_id", "ids"])

    kinds = T.StructType().add("place", "long").add(documents.schema["doc_id"]).add("ids", "binary")
    return documents.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text").mapInArrow(run, kinds)


def statistics(tokens: DataFrame, kind: type, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """Over all documents: in how many each id occurs, how many there are, and how many ids. One row an id at most reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, total = np.zeros(vocabulary, np.int64), 0, 0
        for b in slices(batches):
            for ids in b.column(0):
                found = np.frombuffer(ids.as_buffer(), kind)
                mark = np.zeros(vocabulary, bool)
                mark[found] = True
                held += mark
                rows, total = rows + 1, total + len(found)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [rows, total]))], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(counts.id, counts.n))
    df = np.zeros(vocabulary, np.int64)
    for i, c in n.items():
        if i >= 0:
            df[i] = c
    return df, int(n.get(-1, 0)), int(n.get(-2, 0))


def dealt(tokens: DataFrame, df: np.ndarray, kind: type, n: int, shards: int, shard_tokens: int) -> DataFrame:
    """tokens with `shard`: documents that share a rare id are dealt to one shard, so that a seed finds its best neighbours there.

    A document goes by the id of least hash among those that it shares with at most a twentieth of all documents. Where an id gathers more than an
    eighth of a shard, the id of second least hash divides it, and where even that does (copies), the place does: no shard grows with a hot group.
    """
    order = np.random.default_rng(5).permutation(len(df)).astype(np.int64)  # the hash of an id: its place in a fixed order
    order[(df < 2) | (df > max(2, n // 20))] = len(df)
    shared = tokens.sparkSession.sparkContext.broadcast(order.astype(np.int32))

    def least(ids: pa.Array) -> list[pa.Array]:
        out = np.full((len(ids), 2), -1, np.int64)
        for i, x in enumerate(ids):
            found = np.unique(shared.value[np.frombuffer(x.as_buffer(), kind)])[:2]
            found = found[found < len(shared.value)]
            out[i, :len(found)] = found
        return [pa.array(out[:, 0]), pa.array(out[:, 1])]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size = pa.array([len(x.as_buffer()) // np.dtype(kind).itemsize for x in b.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*least(b.column(0)), size], ["one", "two", "size"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *least(b.column("ids"))], [*b.schema.names, "one", "two"])

    most = shard_tokens // 8
    pairs = written(tokens.select("ids").mapInArrow(sizes, "one long, two long, size long").groupBy("one", "two").agg(F.sum("size").alias("size")), "pairs")
    heavy = written(pairs.groupBy("one").agg(F.sum("size").alias("size")).filter(F.col("size") > most).select("one", F.lit(True).alias("wide")), "heavy")
    copies = written(pairs.filter(F.col("size") > most).select("one", "two", F.ceil(F.col("size") / most).alias("parts")), "copies")
    cell = F.xxhash64("one", F.when(F.col("wide"), F.col("two")), F.when(F.col("wide"), F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1)))))
    rows = tokens.mapInArrow(keys, T.StructType([*tokens.schema]).add("one", "long").add("two", "long"))  # cheaper made again than written with the ids
    return (rows.join(small(heavy), "one", "left").join(small(copies), ["one", "two"], "left")
            .withColumn("shard", F.pmod(cell, F.lit(shards))).select(*tokens.columns, "shard"))


class Index:
    """BM25 over the documents of a shard; idf and the mean length are those of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        term = np.concatenate([f[0] for f in found]).astype(np.int32)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(f[0]) for f in found])
        tf = np.concatenate([f[1] for f in found]).astype(np.float64)
        length = np.array([len(d) for d in docs], np.float64)
        value = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        self.queries = [f[0] for f in found]
        order = np.argsort(term, kind="stable")
        self.doc, self.value = doc[order], value[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))
        # ids in a tenth of the documents or more are rows to add up, the others lists to walk
        often = np.flatnonzero(np.diff(self.at) * 10 > self.n)
        self.row = np.full(len(idf), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), np.float32)
        for r, t in enumerate(often):
            s = slice(self.at[t], self.at[t + 1])
            self.rows[r, self.doc[s]] = self.value[s]

    def neighbours(self, seed: int) -> np.ndarray:
        """The documents that share a term with the seed, best first, ties to the earlier."""
        asked = self.queries[seed]
        row = self.row[asked]
        score = self.rows[row[row >= 0]].sum(axis=0).astype(np.float64)
        spans = [(self.at[t], self.at[t + 1]) for t in asked[row < 0]]
        if spans:
            score += np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), np.concatenate([self.value[a:b] for a, b in spans]), self.n)
        score[seed] = 0
        best = np.nonzero(score)[0]
        return best[np.argsort(-score[best], kind="stable")]


def fill(lengths: list[int], neighbours) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every id once; all windows are full but the last.

    A document's whole windows stand alone. Of the rests the longest unused one is the seed; its neighbours, best first, fill the window, the last
    of them cut to fit, and what is left of it is used later. Where no neighbour is left, the longest unused rests go on.
    """
    pieces, sequence = [], 0
    for d, n in enumerate(lengths):
        for s in range(0, n - n % WINDOW, WINDOW):
            pieces.append((d, s, WINDOW, sequence, 0))
            sequence += 1
    start = [n - n % WINDOW for n in lengths]
    order = sorted((d for d in range(len(lengths)) if start[d] < lengths[d]), key=lambda d: (start[d] - lengths[d], d))
    at, room, turn = 0, 0, iter(())
    while True:
        d = next((x for x in turn if start[x] < lengths[x]), None)
        if d is None:
            while at < len(order) and start[order[at]] >= lengths[order[at]]:
                at += 1
            if at == len(order):
                return pieces
            d = order[at]
            if room and room < WINDOW:
                turn = iter(())
        if not room:
            sequence, room = sequence + (1 if pieces and pieces[-1][3] == sequence else 0), WINDOW
            turn = iter(neighbours(d))
        n = min(room, lengths[d] - start[d])
        pieces.append((d, start[d], n, sequence, WINDOW - room))
        start[d] += n
        room -= n
        if not room:
            turn = iter(())


def pack(documents: DataFrame, path: str = RANKS, shard_tokens: int = 2_000_000, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of documents in windows of 2048 ids.

    Documents are dealt over shards of about shard_tokens ids by rare ids they share (see `dealt`). Each shard is indexed and packed by itself, seeds
    asking with all their ids; only a shard's last window can have padding. Null and empty texts are the end id alone. A special string
    inside a text is its one id. Repeated rows are packed each. No rows: none. The result is the same each time it is computed.
    """
    text_batches(documents.sparkSession)
    vocabulary = max(encoder(path, tokenizer).n_vocab, END + 1)
    kind = id_type(vocabulary)
    tokens = written(tokenize(documents, path, tokenizer), "tokens")
    df, n, total = statistics(tokens, kind, vocabulary)
    shards = max(1, math.ceil(total / shard_tokens))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = documents.sparkSession.sparkContext.broadcast(idf)  # one number an id
    mean = total / max(n, 1)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        docs = [np.frombuffer(i.as_buffer(), kind) for i in t.column("ids")]
        index = Index(docs, shared.value, mean)
        pieces = fill([len(d) for d in docs], index.neighbours)
        del index
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        crc = [zlib.crc32(docs[d][s:s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        first = t.column("shard")[0].as_py() << 32
        release()
        return pa.table({"doc_id": t.column("doc_id").take(pa.array(doc)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()),
                         "doc_tokens": np.array([len(d) for d in docs])[doc], "sequence_id": first + sequence, "offset": offset})

    kinds = T.StructType([documents.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        kinds = kinds.add(name, "long")
    return dealt(tokens, df, kind, n, shards, shard_tokens).groupBy("shard").applyInArrow(run, kinds)

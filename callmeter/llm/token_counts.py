"""Token counts per document, without token ids: each distinct pre-token's pieces are counted once and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import slices, text_batches

#: Code points whose class the fast pattern and the tokenizer agree on, whatever their Unicode versions: Latin, Greek, Cyrillic, Arabic, punctuation,
#: currency signs, arrows and technical signs, kana, ideographs, Hangul. Texts with others are cut by the tokenizer itself. A test compares them all.
STABLE = r"\u0000-\u0523\u0600-\u06ff\u1e00-\u1eff\u2000-\u2064\u20a0-\u20b5\u2190-\u23e7\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
#: Flush what a task has gathered beyond so many rows.
FLUSH = 50_000
#: A longer pre-token is broadcast only if it makes up a thousandth of the sample.
SHORT = 64


class Pretokens:
    """Cuts texts as a byte-level BPE file of the library `tokenizers` does, special strings apart, and counts the pieces of a pre-token."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError("only byte-level tokenizers without a normalizer or prefix space cut texts by pre-tokens alone")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take their surroundings in are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.fast = regex.compile(public_tokenizers.PATTERN).findall
        self.unstable = re.compile(f"[^{STABLE}]").search

    def _cut(self, text: str) -> list[str]:
        if self.unstable(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.fast(text)

    def frequencies(self, text: str) -> Counter:
        """How often each pre-token occurs; a special string is one pre-token of its own."""
        if self.special is None or not self.special.search(text):
            return Counter(self._cut(text))
        out = Counter()
        for k, part in enumerate(self.special.split(text)):
            out.update([part] if k % 2 else self._cut(part) if part else ())
        return out

    def sizes(self, pieces: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [len(e) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _pretokens(path: str | None) -> Pretokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Pretokens(path)


def frequent(texts: DataFrame, path: str | None, sample: int, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of about `sample` documents: at most `most`, each of SHORT characters or a thousandth of the sample.

    Only decides which pre-tokens are looked up where the document lies and which by a shuffle; counts are the same for any choice.
    """
    rows = texts.count()
    some = texts if rows <= sample else texts.sample(fraction=sample / rows, seed=7)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = _pretokens(path), Counter()
        for batch in slices(batches):
            for text in batch.column("text"):
                seen.update(cut.frequencies(text.as_py()))
                if len(seen) >= FLUSH:
                    yield _table(list(seen), list(seen.values()))
                    seen.clear()
        if seen:
            yield _table(list(seen), list(seen.values()))

    def _table(pieces: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], ["piece", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _pretokens(path)
        for batch in slices(batches):
            yield _table(batch.column("piece").to_pylist(), cut.sizes(batch.column("piece").to_pylist()))

    total = some.agg(F.sum(F.char_length("text"))).first()[0] or 0
    counted = some.mapInArrow(gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = (counted.filter((F.char_length("piece") <= SHORT) | (F.char_length("piece") * F.col("n") * 1000 >= F.lit(total)))
           .orderBy(F.desc("n"), "piece").limit(most).select("piece", "n"))
    return {r.piece: r.n for r in top.mapInArrow(measure, "piece string, n long").toLocalIterator()}


_PARTS = "row long, doc_id long, n_bytes long, piece string, n long"


def _spread(known: Broadcast, path: str | None):
    """A row for each document with the pieces of its frequent pre-tokens, and one for each other pre-token with its frequency in the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sizes, out = _pretokens(path), known.value, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(zip(*out))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "piece", "n"])

        for batch in slices(batches):
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                row, text, total = row.as_py(), text.as_py(), 0
                for piece, n in cut.frequencies(text).items():
                    size = sizes.get(piece)
                    if size is None:
                        out.append((row, None, None, piece, n))
                    else:
                        total += n * size
                out.append((row, doc_id.as_py(), len(text.encode()), None, total))
                if len(out) >= FLUSH:
                    yield flush()
        if out:
            yield flush()
    return run


def _measured(path: str | None):
    """The tokens of each row; pre-tokens come sorted, so each distinct one is cut into pieces once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, last, size = _pretokens(path), None, 0
        for batch in slices(batches):
            coded = batch.column("piece").dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            new = [p for p in pieces if p != last]
            found = dict(zip(new, cut.sizes(new))) | {last: size}
            by = pa.array([found[p] for p in pieces], pa.int64())
            each = pc.fill_null(by.take(coded.indices), 1)  # rows of whole documents bring their tokens along
            yield batch.drop_columns(["piece", "n"]).append_column("n", pc.multiply(each, batch.column("n")))
            if pieces and coded.indices[-1].is_valid:
                last = pieces[coded.indices[-1].as_py()]
                size = found[last]
    return run


def count_tokens(documents: DataFrame, limit: int = 512, path: str | None = None, sample: int = 20_000, most: int = 200_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens as the tokenizer file gives them without added special tokens, over_limit (n_tokens > limit).

    One row for each row of documents, repeated ones too; null doc_id stays null, null or empty text counts nothing, texts are taken whole. The
    file's special strings inside a text are one token each. No rows: none. Other columns are left out.

    The `most` most frequent pre-tokens of a `sample` of documents are broadcast with their piece counts and summed where the document
    lies; all others are dealt by pre-token, their pieces counted once, multiplied with each document's frequency and summed by document.
    So a frequent word fills no task, and what is broadcast has a fixed bound.
    """
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    text_batches(documents.sparkSession)
    known = documents.sparkSession.sparkContext.broadcast(frequent(texts.select("text"), path, sample, most))
    parts = texts.mapInArrow(_spread(known, path), _PARTS)
    key = F.when(F.col("piece").isNull(), F.col("row")).otherwise(F.xxhash64("piece"))  # rows of documents are dealt by themselves
    dealt = parts.repartition(key).sortWithinPartitions("piece")
    counts = dealt.mapInArrow(_measured(path), "row long, doc_id long, n_bytes long, n long")
    return (counts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))

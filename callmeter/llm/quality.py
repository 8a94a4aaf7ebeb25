"""Document quality by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmeter.llm.common import release, slices, text_batches

BUCKETS = 1 << 18
GRADES = 3


def grade(quality: Column, toxic: Column) -> Column:
    """0 for toxic documents, 1 for poor ones, 2 for good ones; null counts as good and not toxic."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 0).when(F.coalesce(quality, F.lit(1)) == 0, 1).otherwise(2)


def features(text: bytes | None) -> np.ndarray:
    """Buckets, each once, of a UTF-8 text in lower case (A-Z): of its words, of their first four bytes and last three, and of
    its shape: how many words repeat the one before, which share of its words is distinct, how many end in no letter or digit."""
    words = (text or b"").lower().split()
    distinct, crc = set(words), zlib.crc32
    again = sum(map(eq, words, islice(words, 1, None)))
    odd = sum(not (w[-1] > 127 or w[-1:].isalnum() or w[-1] in b".,") for w in words)
    n = max(len(words), 1)
    shape = (b"again %d" % again.bit_length(), b"distinct %d %d" % (min(n.bit_length(), 8), 8 * len(distinct) // n), b"odd %d" % min(20 * odd // n, 10))
    found = {crc(w) for w in distinct} | {crc(w, 1) for w in {w[:4] for w in distinct}} | {crc(w, 2) for w in {w[-3:] for w in distinct}}
    found |= {crc(w, 3) for w in shape}
    return np.unique(np.fromiter(found, np.uint32, len(found)) % np.uint32(BUCKETS)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class CumulativeLink:
    """P(grade > k) = sigmoid(score - threshold k), thresholds in ascending order; a score is a sum of weights shared by all grades."""
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 250, rate: float = 0.2, decay: float = 5e-4, known_in: int = 10, power: float = 2.0) -> CumulativeLink:
    """Full-batch Adam on the cumulative logistic likelihood; no rows: every document passes.

    Buckets found in fewer than known_in rows (a hundredth of few rows) keep weight zero: they say more about a document than about its grade. A bucket's
    value is its rarity, a power of log(rows / rows that hold it): else the common words of a long text outweigh a rare telling one.
    """
    model = CumulativeLink(np.zeros(BUCKETS, np.float64), np.array([-3.0, -1.5]))
    if not len(rows):
        return model
    at = np.concatenate(rows)
    which = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    held = np.bincount(at, minlength=BUCKETS)
    known = held >= min(known_in, max(2, len(rows) // 100))
    at, which = at[known[at]], which[known[at]]
    rare = np.where(known, np.log(len(rows) / np.maximum(held, 1)) ** power, 0.0) / np.log(100) ** power
    gap = np.log(np.diff(model.thresholds))  # thresholds: the first, then gaps that stay positive
    state = [model.weights, np.array([model.thresholds[0]]), gap]
    m, v = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for t in range(1, rounds + 1):
        thresholds = np.concatenate([state[1], state[1] + np.cumsum(np.exp(state[2]))])
        scores = np.bincount(which, (state[0] * rare)[at], len(rows))
        tail = _sigmoid(scores[:, None] - thresholds[None, :])
        # d log-likelihood / d (score - threshold k): of P(y) = tail[y-1] - tail[y], with tail[-1] = 1 and tail[last] = 0
        full = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        slope = full * (1 - full)
        by_threshold = np.zeros((len(rows), GRADES + 1))
        by_threshold[i, grades] += slope[i, grades] / p
        by_threshold[i, grades + 1] -= slope[i, grades + 1] / p
        g = -by_threshold[:, 1:GRADES] / len(rows)
        by_score = g.sum(1)
        down = -g.sum(0)
        grads = [np.bincount(at, by_score[which], BUCKETS) * rare + decay * state[0], np.array([down.sum()]), np.cumsum(down[::-1])[::-1][1:] * np.exp(state[2])]
        step = rate * (1 - (t - 1) / rounds)  # smaller and smaller: it settles
        for s, d, a, b in zip(state, grads, m, v):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            s -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return CumulativeLink(state[0] * rare, np.concatenate([state[1], state[1] + np.cumsum(np.exp(state[2]))]))


def _features_of(rows: DataFrame, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pa.array([features(t.as_py()).tobytes() for t in b.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], found], [*keep, "found"])

    kinds = T.StructType([rows.schema[c] for c in keep]).add("found", "binary")
    return rows.select(F.col("text").cast("binary").alias("__text"), *keep).mapInArrow(run, kinds)


def train(documents: DataFrame, labels: DataFrame, sample: int = 6000) -> CumulativeLink:
    """Fits on at most `sample` labelled documents, those of the smallest hashed ids: a sample of all labels, of a fixed size.

    The sample is fitted in one task, so that the driver gets the model and none of the rows.
    Of several labels of a document the worst grade counts. Labels without a document, or without doc_id, are left out.
    """
    graded = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("__grade"))
    ids = documents.select("doc_id").filter("doc_id is not null")
    chosen = graded.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    held = _features_of(rows, "doc_id", "__grade").orderBy("doc_id", "found").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, grades = [], [np.zeros(0, np.int64)]
        for b in batches:
            found += [np.frombuffer(f.as_buffer(), np.int32) for f in b.column(0)]
            grades.append(b.column(1).to_numpy().astype(np.int64))
        model = fit(found, np.concatenate(grades))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], ["weights", "thresholds"])
        del found, model
        release()

    made = held.select("found", "__grade").mapInArrow(run, "weights binary, thresholds binary").collect()
    return CumulativeLink(*(np.frombuffer(x, np.float64) for x in made[0])) if made else fit([], np.zeros(0, np.int64))


def scored(documents: DataFrame, model: CumulativeLink, least: float = 0.65, passing: bool = False) -> DataFrame:
    """documents with `__expected` (the expected grade), `__tail` (the probability of the best grade) and `__keep` (whether that is `least`).

    passing: only those kept. Null text counts as empty; it and any text without known words get the thresholds' own probabilities.
    """
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = CumulativeLink(*shared.value)
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary())  # the same bytes, not a copy
            scores = np.array([known.score(features(t.as_py())) for t in texts], np.float64)
            tails = known.tails(scores)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)],
                                             [*names, "__expected", "__tail", "__keep"])
            yield out.filter(out.column("__keep")) if passing else out

    kinds = T.StructType(list(documents.schema)).add("__expected", "double").add("__tail", "double").add("__keep", "boolean")
    return documents.mapInArrow(run, kinds)


def select(documents: DataFrame, labels: DataFrame, least: float = 0.65, sample: int = 6000) -> DataFrame:
    """The rows of documents that the classifier keeps: the probability of the best grade is `least` or more. All columns stay.

    Null and empty texts have the thresholds' own probability, as have all texts where there are no labels. Repeated rows are treated alike, null
    doc_ids are scored and never trained on, several labels of a document count as the worst. Long texts are read whole. No rows: none.
    """
    return scored(documents, train(documents, labels, sample), least, True).drop("__expected", "__tail", "__keep")


def report(documents: DataFrame, labels: DataFrame, least: float = 0.65, sample: int = 6000) -> DataFrame:
    """(doc_id, expected_grade, tail_probability) of the documents that `select` keeps, one row for each of their rows."""
    rows = scored(documents.select("doc_id", "text"), train(documents, labels, sample), least, True)
    return rows.select("doc_id", F.col("__expected").alias("expected_grade"), F.col("__tail").alias("tail_probability"))

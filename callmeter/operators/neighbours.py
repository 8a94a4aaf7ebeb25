"""Past prompts most alike in words: an exact top-k cosine join that reads time from the prompt backwards.

Prompts are numbered in time and cut into windows. A task holds the prompts of a window, and some later ones that are still open, and scores
the one against the other in memory: what leaves it are the k best of each, never the pairs. A prompt is held against its own window, then the
one before, the two before that, four and so on. What is unread is older, and can at most be as alike as the prompt's words that occur there
allow (the largest weight in each list, and Cauchy's bound). Prompts whose k nearest can't change any more leave; early ones have nothing left
to read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.functions.text import words
from callmeter.session import cut, dealt, stored

c = F.col
K, MIN_SIM, COMMON = 30, 0.1, 0.05
#: Prompts a window; numbers that a task works on at once; up to how many open prompts are sent to every task that has closed ones.
WINDOW, CELLS, FEW = 16_384, 2_000_000, 500_000


def word_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(words(c(text))).alias("word"))


def vectors(rows: DataFrame, key: str, n, df: DataFrame, keep) -> DataFrame:
    """(key, word, w): unit-length TF-IDF weights over the words that are kept."""
    idf = df.filter(keep(c("df"), n)).select("word", F.ln(n / c("df")).alias("idf"))
    weighted = rows.join(idf, "word")
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(c("idf") * c("idf"))).alias("norm"))
    return weighted.join(norm, key).select(key, "word", F.when(c("norm") > 0, c("idf") / c("norm")).otherwise(c("idf")).alias("w"))


def in_time(docs: DataFrame, key: str, order: str) -> DataFrame:
    """docs (key, order, ...) with `window`: WINDOW of them in time a number, from 0. Ranges of about equal size are numbered, one count a range carries on."""
    placed = stored(docs.repartitionByRange(order, key).sortWithinPartitions(order, key).withColumn("__at", F.monotonically_increasing_id()), "in-time")
    part, inside = F.shiftright("__at", 33), c("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .select(*docs.columns, F.floor((inside + c("__offset")) / WINDOW).alias("window")))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """How long each list is, and what the lists hold."""
    one = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return one.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), one.flatten()


def best_of(asked: pa.Table, held: pa.Table, key: str, order: str, k: int, min_sim: float) -> pa.Array:
    """For each row of asked its k most alike earlier rows of held, as a list of (sim, near_order, near_id), best first; only such above its `kth`.

    Both have (key, order, words, ws), words without repeats; asked has `kth` as well.
    """
    held = held.sort_by([(order, "ascending"), (key, "ascending")])
    (n_q, w_q), (n_d, w_d) = _flat(asked.column("words")), _flat(held.column("words"))
    both = pa.chunked_array([w_q, w_d]).combine_chunks().dictionary_encode()
    names = len(both.dictionary)
    word = both.indices.to_numpy()
    asked_w, held_w = word[:len(w_q)], word[len(w_q):]
    x_q, x_d = (_flat(t.column("ws"))[1].to_numpy() for t in (asked, held))
    by_word = np.argsort(held_w, kind="stable")
    doc, x_d = np.repeat(np.arange(held.num_rows), n_d)[by_word], x_d[by_word]
    begin = np.searchsorted(held_w[by_word], np.arange(names + 1))
    count = np.diff(begin)
    orders = held.column(order).to_numpy()
    earlier = np.searchsorted(orders, asked.column(order).to_numpy(), side="left")
    kth = asked.column("kth").to_numpy()
    first = np.append(0, np.cumsum(n_q))  # of each row's words
    work = np.append(0, np.cumsum(count[asked_w]))[first]  # products of words before each row
    rows, docs, sims, at = [], [], [], 0
    while at < asked.num_rows:
        size = max(held.num_rows, 1)
        to = min(int(np.searchsorted(work, work[at] + CELLS, side="right")) - 1, at + max(CELLS // size, 1))
        to = max(min(to, asked.num_rows), at + 1)
        mine = slice(first[at], first[to])
        n = count[asked_w[mine]]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[asked_w[mine]] - (ends - n), n)
        row = np.repeat(np.repeat(np.arange(to - at), n_q[at:to]), n)
        dots = np.bincount(row * size + doc[place], np.repeat(x_q[mine], n) * x_d[place], minlength=1)
        found = np.flatnonzero(dots > min_sim - 1e-6)
        sim, (row, col) = np.round(dots[found], 9), np.divmod(found, size)
        good = (sim >= min_sim) & (sim > kth[at + row]) & (col < earlier[at + row])
        sim, row, col = sim[good], row[good], col[good]
        best = np.lexsort((-col, -sim, row))
        sim, row, col = sim[best], row[best], col[best]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[top] + at)
        docs.append(col[top])
        sims.append(sim[top])
        at = to
    rows, docs, sims = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((rows, np.int64), (docs, np.int64), (sims, np.float64)))
    offsets = np.searchsorted(rows, np.arange(asked.num_rows + 1)).astype(np.int32)
    near = pa.StructArray.from_arrays([pa.array(sims), *(held.column(n).combine_chunks().take(pa.array(docs)) for n in (order, key))], ["sim", "near_order", "near_id"])
    return pa.ListArray.from_arrays(pa.array(offsets), near)


def _own_window(key: str, order: str, k: int, min_sim: float, t: pa.Table) -> pa.Table:
    best = best_of(t.append_column("kth", pa.array(np.full(t.num_rows, -1.0))), t, key, order, k, min_sim)
    return t.select([key, order, "window", "norm"]).append_column("best", best)


def _earlier_window(key: str, order: str, k: int, min_sim: float, asked: pa.Table, held: pa.Table) -> pa.Table:
    best = best_of(asked, held, key, order, k, min_sim)
    found = asked.select([key, order]).append_column("more", best)
    return found.filter(pc.greater(pc.list_value_length(best), 0))


def top_lists(vecs: DataFrame, key: str, order: str, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """For each prompt that has any, the k most alike earlier ones (by `order`): (key, order, best), best an array of (sim, near_order, near_id), exact.

    `vecs`: (key, order, word, w), of unit length. Ties go to the later prompt.
    """
    one = vecs.filter(c(key).isNotNull() & c(order).isNotNull()).groupBy(key, order, "word").agg(F.sum("w").alias("w"))
    vector = one.groupBy(key, order).agg(F.array_sort(F.collect_list(F.struct("word", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x["w"] * x["w"])).alias("norm")
    docs = in_time(vector.select(key, order, c("v.word").alias("words"), c("v.w").alias("ws"), norm), key, order)
    last, longest = (x or 0 for x in docs.agg(F.max("window"), F.max("norm")).first())
    # a window is small and takes seconds: partitions are numbered, so that they aren't joined by their size
    most_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, pairs = min(last + 1, most_parts), min(4 * (last + 1), most_parts)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    near = f"array<struct<sim: double, near_order: {kinds[order]}, near_id: {kinds[key]}>>"
    names = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}"
    kth = F.coalesce(F.get("best", F.lit(k - 1))["sim"], F.lit(-1.0))
    can = lambda bound: (F.round(bound + 1e-12, 9) >= min_sim) & (F.round(bound + 1e-12, 9) > kth)
    # what the rest of a word's list can hold: since when there is one, and its largest weight
    heads = cut(docs.select("window", F.explode(F.arrays_zip("words", "ws")).alias("v")).groupBy(c("v.words").alias("word")).agg(
        F.min("window").alias("since"), F.max("v.ws").alias("most")))

    def still_open(found: DataFrame, start: Column) -> DataFrame:
        """What an unread prompt can enter: it is older than all that were read, so it has to be more alike than the k-th."""
        some = found.filter((start > 0) & can(c("norm") * longest)).join(dealt(docs.select(key, order, "words", "ws")), [key, order])
        each = some.select(key, order, "best", start.alias("__start"), F.explode(F.arrays_zip("words", "ws")).alias("v")).select("*", c("v.words").alias("word"), c("v.ws").alias("w"))
        bound = each.join(heads, "word").filter(c("since") < c("__start")).groupBy(key, order).agg(
            F.first("best").alias("best"), F.least(F.sum(c("w") * c("most")), F.sqrt(F.sum(c("w") * c("w"))) * longest).alias("__bound"))
        return cut(some.join(bound.filter(can(c("__bound"))).select(key, order), [key, order], "left_semi"))

    found = stored(docs.repartition(own, "window").groupBy("window").applyInArrow(lambda t: _own_window(key, order, k, min_sim, t), f"{names}, window long, norm double, best {near}"), "own-window")
    parts, back = [], 0  # windows read before a prompt's own
    while True:
        open_q = still_open(found, c("window") - back)
        left = open_q.count()
        if not left:
            break
        closed = open_q.select(key, order)
        parts.append(found.join(F.broadcast(closed) if left <= FEW else dealt(closed), [key, order], "left_anti"))
        # as many open prompts go together as a window has, in time, so that a window is sent to few tasks however few are open
        so_far = F.sum("count").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1))  # one row a window
        chunks = open_q.groupBy("window").count().select("window", F.floor(F.coalesce(so_far, F.lit(0)) / WINDOW).alias("chunk"))
        at = F.explode(F.sequence(F.greatest(c("window") - 2 * back - 1, F.lit(0)), c("window") - back - 1)).alias("at")
        asked = open_q.join(F.broadcast(chunks), "window").select("chunk", key, order, "words", "ws", kth.alias("kth"), at)
        held = docs.select(key, order, "words", "ws", c("window").alias("at")).join(open_q.join(F.broadcast(chunks), "window").select("chunk", at).distinct(), "at")
        held = held.select("chunk", "at", key, order, "words", "ws").toDF("__chunk", "__at", key, order, "words", "ws")
        scored = asked.repartition(pairs, "chunk", "at").groupBy("chunk", "at").cogroup(held.repartition(pairs, "__chunk", "__at").groupBy("__chunk", "__at")).applyInArrow(
            lambda q, d: _earlier_window(key, order, k, min_sim, q, d), f"{names}, more {near}")
        more = scored.groupBy(key, order).agg(F.flatten(F.collect_list("more")).alias("more"))
        best = F.slice(F.sort_array(F.concat("best", F.coalesce("more", F.array().cast(near))), asc=False), 1, k)
        found = stored(open_q.join(dealt(more), [key, order], "left").select(key, order, "window", "norm", best.alias("best")), "earlier-windows")
        back = 2 * back + 1
    for part in parts:
        found = found.unionByName(part)
    return found.filter(F.size("best") > 0).select(key, order, "best")


def top_similar(vecs: DataFrame, key: str, order: str, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """The lists of `top_lists` as rows: (key, near_id, near_order, sim, rank)."""
    near = top_lists(vecs, key, order, k, min_sim).select(key, F.posexplode("best").alias("__at", "__near"))
    return near.select(key, "__near.near_id", "__near.near_order", "__near.sim", (c("__at") + 1).alias("rank"))


def history_vectors(prompts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, word, w) of a history held against itself: df over all prompts, words of more than 5% dropped."""
    rows = word_rows(prompts.select(key, text), key, text)
    n = rows.select(key).distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    df = rows.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n)
    vecs = vectors(rows, key, c("n"), df, lambda d, total: d <= COMMON * total)
    return vecs.join(prompts.select(key, order), key)


def nearest_lists(prompts: DataFrame, key: str, order: str, text: str, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """Leak-free form over a history, a row a prompt: (key, order, best) as in `top_lists`."""
    return top_lists(history_vectors(prompts, key, order, text), key, order, k, min_sim)


def nearest_earlier(prompts: DataFrame, key: str, order: str, text: str, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """Leak-free form over a history: df over all prompts, words of more than 5% dropped, only earlier candidates."""
    return top_similar(history_vectors(prompts, key, order, text), key, order, k, min_sim)


def complete_only(top: DataFrame, key: str, k: int) -> DataFrame:
    """Keep the prompts that have k neighbours; the others get no answer."""
    found = F.count(F.lit(1)).over(Window.partitionBy(key))  # k rows or few more
    return top.filter(c(key).isNotNull()).withColumn("__found", found).filter(c("__found") >= k).drop("__found")


def nearest_in_history(queries: DataFrame, history: DataFrame, key: str, text: str, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """New prompts against a history: word counts include the query, words of 5% or more are ignored, ties by id.

    Each query is a batch of its own in the counts, so a word's weight depends on whether the query holds it;
    both weights are formed per word, not per pair.
    """
    hist = word_rows(history.select(key, text), key, text)
    n = hist.select(key).distinct().agg((F.count(F.lit(1)) + 1).cast("double").alias("n")).scalar()
    df = hist.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n)
    asked = word_rows(queries.select(c(key).alias("query_id"), text), "query_id", text)
    weight = lambda d: F.when(d < COMMON * c("n"), F.ln(c("n") / d)).otherwise(0.0)
    seen = df.select("word", weight(c("df") + 1).alias("w1"), weight(c("df")).alias("w0"))
    fresh = weight(F.lit(1))
    q = asked.withColumn("n", n).join(seen, "word", "left").select("query_id", "word", F.coalesce("w1", fresh).alias("w1"), F.coalesce("w0", F.lit(0.0)).alias("w0"))
    q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(c("w1") * c("w1"))).alias("q_norm"))
    held = hist.join(seen, "word").select(key, "word", "w1", "w0")
    d_norm = held.groupBy(key).agg(F.sum(c("w0") * c("w0")).alias("d_sq"))
    # words both hold weigh w1 on both sides; the rest of the document weighs w0
    common = (q.filter("w1 > 0 OR w0 > 0").select("query_id", "word").join(held, "word").groupBy("query_id", key)
              .agg(F.sum(c("w1") * c("w1")).alias("dot"), F.sum(c("w1") * c("w1") - c("w0") * c("w0")).alias("shift")))
    scored = (common.join(d_norm, key).join(q_norm, "query_id")
              .withColumn("sim", F.round(c("dot") / (c("q_norm") * F.sqrt(c("d_sq") + c("shift"))), 9)).filter(c("sim") >= min_sim))
    best = Window.partitionBy("query_id").orderBy(c("sim").desc(), c(key).desc())
    top = scored.withColumn("rank", F.row_number().over(best)).filter(c("rank") <= k)
    return complete_only(top.select("query_id", c(key).alias("near_id"), "sim", "rank"), "query_id", k)

"""Exact percentiles that no single task has to hold, and leak-free expanding quantiles.

All percentiles interpolate linearly between the two nearest ranks, k = (n - 1) q.
"""

from __future__ import annotations

import bisect
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from callmeter.operators.ordered import SLICE, with_slices
from callmeter.session import cut

c = F.col
ALL = "__all"
# rows one Python task replays in order; smaller than the limit for JVM windows
REPLAY_ROWS = 250_000


def log_bin(value: Column) -> Column:
    """A bin number that never decreases with the value; about 0.07% wide, finer than a dollar's millionth near 0."""
    return (F.signum(value) * F.floor(F.ln(1 + F.abs(value) * 1e6) * 1500)).cast("bigint")


def exact_percentiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Percentiles of a real-valued measure per group, spread over bins.

    Equal values are counted first; bins give the ranks, and only the bins that hold a wanted
    rank are ordered, each in its own task. For whole-number measures with few distinct
    values the built-in `percentile` is enough and cheaper.
    """
    keys = by or [ALL]
    if not by:
        df = df.withColumn(ALL, F.lit(0))
    cells = (df.filter(c(value).isNotNull()).groupBy(*keys, c(value).cast("double").alias("v"))
             .agg(F.count(F.lit(1)).alias("n")).withColumn("bin", log_bin(c("v"))))
    up = Window.partitionBy(*keys).orderBy("bin")  # at most ~160,000 bins whatever the data
    ladder = cells.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).withColumns({
        "below": F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("n").over(Window.partitionBy(*keys))})
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in qs.items()]))
    k = (c("total") - 1) * c("w.q")
    picks = (
        ladder.withColumn("w", want).withColumn("k", k)
        .select(*keys, "bin", "below", "n", c("w.name").alias("name"), (c("k") - F.floor("k")).alias("frac"),
                F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.floor("k").alias("r")),
                                  F.struct(F.lit("hi").alias("side"), F.ceil("k").alias("r")))).alias("p"))
        .filter((c("p.r") >= c("below")) & (c("p.r") < c("below") + c("n")))
        .select(*keys, "bin", "name", "frac", "p.side", (c("p.r") - c("below")).alias("r"))
    )
    inside = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (cells.join(picks.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi")
              .withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))))
    hit = (ranked.join(picks, [*keys, "bin"]).filter((c("r") >= c("before")) & (c("r") < c("before") + c("n")))
           .groupBy(*keys, "name").agg(F.max(F.when(c("side") == "lo", c("v"))).alias("lo"),
                                       F.max(F.when(c("side") == "hi", c("v"))).alias("hi"), F.max("frac").alias("frac"))
           .withColumn("x", c("lo") + (c("hi") - c("lo")) * c("frac")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(c("name") == n, c("x"))).alias(n) for n in qs]).drop(ALL)


# ------------------------------------------------------------------ expanding quantiles


def _ends(n: int, qs: list[float]) -> Iterator[tuple[int, int, float]]:
    for q in qs:
        k = (n - 1) * q
        lo = int(k)
        yield lo, min(lo + (k > lo), n - 1), k - lo


def _replay(order: list[str], value: str, names: list[str], qs: list[float]):
    """One group, oldest first: quantiles of the values before each row."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        seen: list[float] = []
        out = np.full((len(rows), len(qs)), np.nan)
        before = np.zeros(len(rows), dtype="int64")
        for i, y in enumerate(rows[value].to_numpy(dtype="float64", na_value=np.nan)):
            before[i] = len(seen)
            if seen:
                out[i] = [seen[lo] + (seen[hi] - seen[lo]) * f for lo, hi, f in _ends(len(seen), qs)]
            if y == y:
                bisect.insort(seen, y)
        rows["n_before"] = before
        for j, name in enumerate(names):
            rows[name] = out[:, j]
        return rows
    return run


class _Counts:
    """Counts per bin that can be added to, and asked for the bin holding a rank (Fenwick tree)."""

    def __init__(self, start: np.ndarray):
        self.size = len(start)
        self.tree = [0] * (self.size + 1)
        cum = np.concatenate([[0], np.cumsum(start)])
        for i in range(1, self.size + 1):
            self.tree[i] = int(cum[i] - cum[i - (i & -i)])
        self.total = int(cum[-1])
        self.top = 1 << max(self.size.bit_length() - 1, 0)

    def add(self, i: int) -> None:
        i += 1
        while i <= self.size:
            self.tree[i] += 1
            i += i & -i
        self.total += 1

    def locate(self, rank: int) -> tuple[int, int]:
        """(bin index, rank inside the bin) of the 0-based rank."""
        at, step = 0, self.top
        while step:
            nxt = at + step
            if nxt <= self.size and self.tree[nxt] <= rank:
                rank -= self.tree[nxt]
                at = nxt
            step >>= 1
        return at, rank


def _replay_slice(order: list[str], value: str, qs: list[float], cols: list[str]):
    """One slice, given how many earlier values of its group fall in each bin."""
    def run(rows: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        live = rows["__bin"].notna()
        bins = np.unique(np.concatenate([rows.loc[live, "__bin"].to_numpy("int64"), earlier["__e_bin"].to_numpy("int64")]))
        start = np.zeros(len(bins), dtype="int64")
        start[np.searchsorted(bins, earlier["__e_bin"].to_numpy("int64"))] = earlier["__before"].to_numpy("int64")
        counts = _Counts(start)
        place = np.searchsorted(bins, rows["__bin"].fillna(0).to_numpy("int64"))
        parts = np.full((len(rows), len(qs) * 5), np.nan)
        before = np.zeros(len(rows), dtype="int64")
        for i in range(len(rows)):
            before[i] = counts.total
            if counts.total:
                cells: list[float] = []
                for lo, hi, f in _ends(counts.total, qs):
                    (a, ra), (b, rb) = counts.locate(lo), counts.locate(hi)
                    cells += [bins[a], ra, bins[b], rb, f]
                parts[i] = cells
            if live[i]:
                counts.add(place[i])
        rows["n_before"] = before
        for j in range(len(qs)):
            for m, part in enumerate(("lob", "lor", "hib", "hir", "f")):
                rows[f"__{part}{j}"] = parts[:, j * 5 + m]
        return rows[cols]
    return run


def _kth_in_bin(order: list[str]):
    """One bin: answer 'the r-th smallest value of this bin before that row' in order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "__ask"], ascending=[True] * len(order) + [False], kind="stable")
        seen: list[float] = []
        found = np.full(len(rows), np.nan)
        for i, (ask, r, y) in enumerate(zip(rows["__ask"].to_numpy(), rows["__r"].to_numpy(), rows["__y"].to_numpy())):
            if ask:
                found[i] = seen[int(r)]
            else:
                bisect.insort(seen, y)
        rows["__x"] = found
        return rows.loc[rows["__ask"] == 1, ["__rid", "__which", "__x"]]
    return run


def expanding_quantiles(df: DataFrame, value: str, order: list[str], qs: dict[str, float], by: list[str] | None = None,
                        whole: bool = True, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Per row, quantiles of `value` over the rows strictly before it (in its group), and `n_before`.

    `order` starts with a time in microseconds and is unique. A null value is answered but does not count
    for later rows. `whole` says the values are whole numbers of a small range (turns), so each
    value is its own bin; otherwise (costs) values are binned and ranks are settled bin by bin.

    A group over the limit is cut into slices of consecutive rows: slice by slice, the counts
    of all earlier slices per bin are enough to say in which bin a rank falls.
    """
    names, fractions = list(qs), list(qs.values())
    keys = by or [ALL]
    if not by:
        df = df.withColumn(ALL, F.lit(0))
    limit = limit or min(REPLAY_ROWS, int(df.sparkSession.conf.get("spark.callmeter.group.maxRows", str(REPLAY_ROWS))))
    df = df.withColumn(value, c(value).cast("double"))
    sliced = with_slices(df, keys, order[0], rows, limit)
    fields = [T.StructField("n_before", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]]
    if SLICE not in sliced.columns:
        schema = T.StructType([*df.schema.fields, *fields])
        return df.groupBy(*keys).applyInPandas(_replay(order, value, names, fractions), schema).drop(ALL)
    return _sliced_quantiles(sliced, value, order, names, fractions, keys, whole, limit).drop(ALL, SLICE)


def _sliced_quantiles(df: DataFrame, value: str, order: list[str], names: list[str], qs: list[float], keys: list[str],
                      whole: bool, limit: int) -> DataFrame:
    df = cut(df)  # read four times below; the narrow table is written once in the shared folder
    if whole:
        df = df.withColumn("__bin", c(value).cast("bigint"))
    else:
        # a value repeated more often than half the limit gets a bin of its own; there are at
        # most 2 x rows / limit such values, so this side is small by construction
        heavy = (df.filter(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
                 .filter(c("__n") > limit // 2).groupBy(*keys, log_bin(c(value)).alias("__lb"))
                 .agg(F.collect_list(value).alias("__heavy")))
        low = F.coalesce(F.aggregate("__heavy", F.lit(0).cast("bigint"), lambda a, h: a + F.when(h < c(value), 2).when(
            h == c(value), 1).otherwise(0)), F.lit(0))
        df = (df.withColumn("__lb", log_bin(c(value))).join(F.broadcast(heavy), [*keys, "__lb"], "left")
              .withColumn("__bin", F.when(c("__lb").isNotNull(), c("__lb") * (1 << 20) + low)).drop("__heavy", "__lb"))
    counts = df.filter(c("__bin").isNotNull()).groupBy(*keys, "__bin", SLICE).agg(F.count(F.lit(1)).alias("__n"))
    ends = df.groupBy(*keys).agg(F.max(SLICE).alias("__end"))
    grid = (counts.groupBy(*keys, "__bin").agg(F.min(SLICE).alias("__from")).join(ends, keys)
            .select(*keys, "__bin", F.explode(F.sequence("__from", "__end")).alias(SLICE)))
    so_far = Window.partitionBy(*keys, "__bin").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (grid.join(counts, [*keys, "__bin", SLICE], "left")
               .withColumn("__before", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).cast("bigint"))
               .filter("__before > 0")
               .select(*[c(n).alias(f"__e_{n}") for n in (*keys, SLICE)], c("__bin").alias("__e_bin"), "__before"))
    parts = [T.StructField(f"__{p}{j}", T.DoubleType()) for j in range(len(qs)) for p in ("lob", "lor", "hib", "hir", "f")]
    schema = T.StructType([*df.schema.fields, T.StructField("n_before", T.LongType()), *parts])
    part = [*keys, SLICE]
    found = df.groupBy(*part).cogroup(earlier.groupBy(*[f"__e_{n}" for n in part])).applyInPandas(
        _replay_slice(order, value, qs, [f.name for f in schema.fields]), schema)
    drop = ["__bin", *[f.name for f in parts]]
    if whole:
        for j, name in enumerate(names):
            found = found.withColumn(name, c(f"__lob{j}") + (c(f"__hib{j}") - c(f"__lob{j}")) * c(f"__f{j}"))
        return found.drop(*drop)

    asks = F.array(*[F.struct(F.lit(f"{side}{j}").alias("which"), c(f"__{side}b{j}").cast("bigint").alias("bin"),
                              c(f"__{side}r{j}").cast("bigint").alias("r")) for j in range(len(qs)) for side in ("lo", "hi")])
    found = cut(found.withColumn("__rid", F.to_json(F.struct(*keys, *order))))
    asked = (found.filter(c("n_before") > 0).select(*keys, *order, "__rid", F.explode(asks).alias("a"))
             .select(*keys, *order, "__rid", c("a.which").alias("__which"), c("a.bin").alias("__bin"), c("a.r").alias("__r"),
                     F.lit(1).alias("__ask"), F.lit(None).cast("double").alias("__y")))
    alone = df.filter(c("__bin").isNotNull()).groupBy(*keys, "__bin").agg(
        F.min(value).alias("__v"), F.max(value).alias("__vmax")).filter(c("__v") == c("__vmax")).drop("__vmax")
    held = df.filter(c("__bin").isNotNull()).select(
        *keys, *order, F.lit(None).cast("string").alias("__rid"), F.lit(None).cast("string").alias("__which"), "__bin",
        F.lit(None).cast("bigint").alias("__r"), F.lit(0).alias("__ask"), c(value).alias("__y"))
    same = asked.join(alone, [*keys, "__bin"]).select("__rid", "__which", c("__v").alias("__x"))
    rest = asked.unionByName(held).join(alone, [*keys, "__bin"], "left_anti")
    sorted_out = rest.groupBy(*keys, "__bin").applyInPandas(_kth_in_bin(order), "__rid string, __which string, __x double")
    answers = same.unionByName(sorted_out).groupBy("__rid").agg(
        *[F.max(F.when(c("__which") == f"{side}{j}", c("__x"))).alias(f"__{side}{j}") for j in range(len(qs)) for side in ("lo", "hi")])
    out = found.join(answers, "__rid", "left")
    for j, name in enumerate(names):
        out = out.withColumn(name, c(f"__lo{j}") + (c(f"__hi{j}") - c(f"__lo{j}")) * c(f"__f{j}"))
    return out.drop(*drop, "__rid", *[f"__{s}{j}" for j in range(len(qs)) for s in ("lo", "hi")])

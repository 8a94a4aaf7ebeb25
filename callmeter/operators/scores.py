"""How good an interval is: coverage, interval score, errors, and session-bootstrap intervals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.operators.quantiles import exact_percentiles
from callmeter.session import cut

c = F.col
NOMINAL = 0.80
ALPHA = 0.2
SPREAD_LIMIT = 100
INTERVAL = {"lo": 0.125, "p50": 0.5, "hi": 0.875}
MIN_BASIS = 8
BOOTSTRAP = 400


def inside(lo: Column, y: Column, hi: Column) -> Column:
    return (lo <= y) & (y <= hi)


def interval_score(lo: Column, y: Column, hi: Column, alpha: float = ALPHA) -> Column:
    """Width plus 2/alpha times how far the outcome fell outside."""
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(0)
    return (hi - lo) + (2 / alpha) * miss


def log_error(estimate: Column, actual: Column) -> Column:
    return F.when((estimate > 0) & (actual > 0), F.ln(estimate / actual))


def measures(items: DataFrame) -> DataFrame:
    """Items (lo, y, hi, mid) with the per-item measures the metrics average or rank."""
    lo, y, hi, mid = (c(n).cast("double") for n in ("lo", "y", "hi", "mid"))
    return items.withColumns({
        "coverage": inside(lo, y, hi).cast("double"), "interval_score": interval_score(lo, y, hi),
        "abs_error": F.abs(mid - y), "log_error": log_error(mid, y), "width": hi - lo})


MEANS = ("coverage", "interval_score")
MEDIANS = ("abs_error", "log_error", "width")


def interval_metrics(items: DataFrame, by: list[str] | None = None, wide: bool = False) -> DataFrame:
    """Per group: n, sessions, means and medians. `wide`: the measures are real-valued with many distinct values."""
    by = by or []
    m = measures(items)
    if wide:  # read once per median below
        m = cut(m.select(*by, "session_key", *MEANS, *MEDIANS))
    base = m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("session_key").alias("sessions"),
        *[F.round(F.avg(x), 6).alias(x) for x in MEANS],
        *([] if wide else [F.round(F.percentile(x, F.lit(0.5)), 6).alias(x) for x in MEDIANS]))
    if not wide:
        return base
    keys = by or ["__one"]
    base = base if by else base.withColumn("__one", F.lit(0))
    for x in MEDIANS:
        med = exact_percentiles(m, by, x, {x: 0.5}).withColumn(x, F.round(x, 6))
        base = base.join(med if by else med.withColumn("__one", F.lit(0)), keys, "left")
    return base.drop("__one")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, low, median and high of a whole-number measure, and whether it spreads too wide for an interval."""
    q = F.percentile(c(value), F.array(*[F.lit(x) for x in INTERVAL.values()]))
    d = df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("q"))
    return (d.withColumns({n: F.round(c("q")[i], 6) for i, n in enumerate(INTERVAL)}).drop("q")
            .withColumn("ratio", F.when(c("lo") != 0, F.round(c("hi") / c("lo"), 6)))
            .withColumn("spread", F.coalesce(c("ratio") >= SPREAD_LIMIT, F.lit(True))))


def verdict(n: Column, spread: Column, ratio: Column) -> Column:
    return (F.when(n.isNull() | (n == 0), "no tasks").when(n < MIN_BASIS, "too few")
            .when(spread, "too spread").when(ratio < 4, "tight").otherwise("wide"))


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(c(value), F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    d = df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("q"))
    return d.select(*by, "n", *[F.round(c("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))])


# ------------------------------------------------------------------ session bootstrap


#: Upper ends of the shares of a Poisson(1) draw that are 0, 1, 2, ... as eight hex digits.
DRAWS = [format(min(int(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))), 2**32 - 1), "08x") for n in range(12)]


def draw(digits: Column) -> Column:
    """A Poisson(1) number from eight hex digits."""
    out = F.when(digits < DRAWS[0], 0)
    for n, end in enumerate(DRAWS[1:], 1):
        out = out.when(digits < end, n)
    return out.otherwise(len(DRAWS)).cast("bigint")


def weights(session: Column, n: int = BOOTSTRAP) -> Column:
    """How often each of n resamples takes a session, as an array: Poisson draws from md5(block:session), four to a digest.

    Resampling sessions as a whole then needs nothing but the session's own name: no list of sessions, no numbering, no join.
    """
    def block(b: Column) -> Column:
        digest = F.md5(F.concat(b.cast("string"), F.lit(":"), session.cast("string")))
        return F.flatten(F.transform(F.array(digest), lambda h: F.array(*[draw(F.substring(h, 1 + 8 * k, 8)) for k in range(4)])))

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-n // 4) - 1)), block)), 1, n)


def bootstrap(items: DataFrame, by: list[str] | None = None, means: tuple = MEANS, medians: tuple = MEDIANS,
              n: int = BOOTSTRAP, level: float = 0.95) -> DataFrame:
    """Percentile confidence intervals (name_lo, name_hi) of means and medians, resampling whole sessions.

    Means need one partial sum per session; medians one count per (session, value). Both meet the session's array of n weights where
    they lie and leave as sums per resample (and value), so no table of sessions times resamples is made. Groups with
    fewer than two sessions give no row.
    """
    by = by or []
    keys = by or ["__g"]
    if not by:
        items = items.withColumn("__g", F.lit(0))
    items = cut(items.select(*keys, "session_key", *means, *medians))  # read three times below
    enough = items.groupBy(*keys).agg(F.countDistinct("session_key").alias("__s")).filter("__s > 1").drop("__s")
    drawn = F.posexplode(weights(c("session_key"), n)).alias("i", "w")
    parts = []
    if means:
        sums = items.groupBy(*keys, "session_key").agg(
            *[F.sum(x).alias(f"s_{x}") for x in means], *[F.count(x).alias(f"n_{x}") for x in means])
        each = sums.select(*keys, *[f"{a}_{x}" for x in means for a in "sn"], drawn).filter("w > 0")
        found = each.groupBy(*keys, "i").agg(*[(F.sum(c("w") * c(f"s_{x}")) / F.sum(c("w") * c(f"n_{x}"))).alias(x) for x in means])
        parts.append(found.select(*keys, "i", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), c(x).alias("x")) for x in means])).alias("m")))
    if medians:
        cells = (items.select(*keys, "session_key", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), c(x).cast("double").alias("x")) for x in medians])).alias("m"))
                 .filter("m.x IS NOT NULL").groupBy(*keys, "session_key", "m").agg(F.count(F.lit(1)).alias("f")))
        counts = cells.select(*keys, "m", "f", drawn).filter("w > 0").groupBy(*keys, "i", "m").agg(F.sum(c("w") * c("f")).alias("f"))
        sample = Window.partitionBy(*keys, "i", "m.name")  # one row per distinct value
        ranked = counts.withColumns({"upto": F.sum("f").over(sample.orderBy("m.x")), "k": (F.sum("f").over(sample) - 1) / 2})
        ends = ranked.groupBy(*keys, "i", c("m.name").alias("name")).agg(
            F.min(F.when(c("upto") > F.floor("k"), c("m.x"))).alias("lo"), F.min(F.when(c("upto") > F.ceil("k"), c("m.x"))).alias("hi"))
        parts.append(ends.select(*keys, "i", F.struct("name", ((c("lo") + c("hi")) / 2).alias("x")).alias("m")))
    found = reduce(DataFrame.unionByName, parts).filter("m.x IS NOT NULL").select(*keys, "m.*")
    every = Window.partitionBy(*keys, "name")  # n rows
    r = found.withColumns({"rn": F.row_number().over(every.orderBy("x")) - 1, "m": F.count(F.lit(1)).over(every)})
    low, high = (F.floor((1 + s * level) / 2 * (c("m") - 1) + 1e-9) for s in (-1, 1))
    picked = [F.round(F.max(F.when((c("rn") == at) & (c("name") == x), c("x"))), 6).alias(f"{x}_{end}")
              for x in (*means, *medians) for end, at in (("lo", low), ("hi", high))]
    return r.groupBy(*keys).agg(*picked).join(enough, keys, "left_semi").drop("__g")

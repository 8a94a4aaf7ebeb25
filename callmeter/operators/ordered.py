"""Running values over ordered groups that may be too big for one task.

A plain window puts a whole group into one task. One session may hold a third of
all calls, so every order-dependent operator here goes through `scan`, which has
two forms with the same result:

* no group is over the limit: one window per group;
* some group is: the rows carry a `slice` column (consecutive in the group's
  order, a bounded number of rows each). Windows run inside (group, slice); one
  summary row per slice is carried forward (or back) over the slices of a group,
  and joined back on (group, slice). The data is shuffled once, on that pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.session import group_rows

SLICE = "slice"
MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Running:
    kind: str  # sum | last | next
    expr: Column
    inclusive: bool


def running_sum(expr: Column, inclusive: bool = True) -> Running:
    return Running("sum", expr, inclusive)


def last_seen(expr: Column, inclusive: bool = False) -> Running:
    """Last non-null value at or before (inclusive) / strictly before the row."""
    return Running("last", expr, inclusive)


def next_seen(expr: Column, inclusive: bool = False) -> Running:
    """First non-null value at or after (inclusive) / strictly after the row."""
    return Running("next", expr, inclusive)


def _frame(window, spec: Running):
    if spec.kind == "next":
        return window.rowsBetween(0 if spec.inclusive else 1, Window.unboundedFollowing)
    return window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)


def _over(spec: Running, value: Column, window) -> Column:
    frame = _frame(window, spec)
    if spec.kind == "sum":
        return F.coalesce(F.sum(value).over(frame), F.lit(0))
    if spec.kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return F.first(value, ignorenulls=True).over(frame)


def scan(df: DataFrame, key: list[str], order: list[str], **specs: Running) -> DataFrame:
    """Add one column per spec, in the order given by `order` inside each `key` group."""
    if SLICE not in df.columns:
        window = Window.partitionBy(*key).orderBy(*order)
        return df.withColumns({name: _over(s, s.expr, window) for name, s in specs.items()})

    part = [*key, SLICE]
    values = df.withColumns({f"__v_{n}": s.expr for n, s in specs.items()})
    local = Window.partitionBy(*part).orderBy(*order)
    pos = F.struct(*order)

    def summary(name: str, s: Running) -> Column:
        v = F.col(f"__v_{name}")
        if s.kind == "sum":
            return F.sum(v)
        at = F.when(v.isNotNull(), pos)
        return F.max_by(v, at) if s.kind == "last" else F.min_by(v, at)

    # one row per slice: bounded by rows / limit plus the number of groups
    per_slice = values.groupBy(*part).agg(*[summary(n, s).alias(f"__s_{n}") for n, s in specs.items()])
    across = Window.partitionBy(*key).orderBy(SLICE)
    carried = per_slice.select(*part, *[
        _over(Running(s.kind, s.expr, False), F.col(f"__s_{n}"), across).alias(f"__c_{n}")
        for n, s in specs.items()])
    joined = values.join(carried, part, "left")

    def merged(name: str, s: Running) -> Column:
        here = _over(s, F.col(f"__v_{name}"), local)
        carry = F.col(f"__c_{name}")
        return here + F.coalesce(carry, F.lit(0)) if s.kind == "sum" else F.coalesce(here, carry)

    out = joined.withColumns({n: merged(n, s) for n, s in specs.items()})
    return out.drop(*[f"__v_{n}" for n in specs], *[f"__c_{n}" for n in specs])


def with_slices(df: DataFrame, key: list[str], t_us: str, rows: int | None = None,
                limit: int | None = None) -> DataFrame:
    """Cut groups over the limit into consecutive slices of bounded size.

    `rows` is a known upper bound on the row count (e.g. from the file footers); at or
    below the limit no group can be over it and the table is returned as it is. A slice
    ends at a minute boundary, so it holds at most the limit plus one minute of its group.
    """
    limit = limit or group_rows(df.sparkSession)
    if SLICE in df.columns:
        df = df.drop(SLICE)
    if (df.count() if rows is None else rows) <= limit:
        return df
    minute = F.floor(F.col(t_us) / F.lit(MINUTE_US)).cast("bigint")
    per_minute = df.groupBy(*key, minute.alias("__minute")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        per_minute
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(*key)))
        .filter(F.col("__total") > limit)  # only the hot groups have cuts
        .withColumn(SLICE, F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / F.lit(limit)).cast("bigint"))
        .select(*key, "__minute", SLICE)
    )
    return (
        df.withColumn("__minute", minute)
        .join(cuts, [*key, "__minute"], "left")
        .withColumn(SLICE, F.coalesce(SLICE, F.lit(0).cast("bigint")))
        .drop("__minute")
    )


def merge(left: DataFrame, right: DataFrame, key: list[str], t_us: str, rows: int | None = None) -> DataFrame:
    """Union of two tables that are to be scanned in one order, cut into common slices where a group is over the limit."""
    if SLICE in left.columns and SLICE in right.columns:
        return left.unionByName(right, allowMissingColumns=True)
    both = left.drop(SLICE).unionByName(right.drop(SLICE), allowMissingColumns=True)
    return with_slices(both, key, t_us, rows)

"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import written


def _follow(hook: DataFrame) -> DataFrame:
    """(node, to) with every `to` replaced by the end of its chain, by pointer doubling; `to` < node except at the ends."""
    while True:
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = written(hook.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "follow")
        hook = step.select("node", "to")
        if step.filter("moved").isEmpty():
            return hook


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long and not null; root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour (a partial aggregate, so a hub costs its task one row per map task),
    shortens the chains by pointer doubling and contracts the edges. Nodes at least halve per round. All joins are plain
    equi joins of tables on disk, whose hot keys adaptive execution can split. No edges: no rows.
    """
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _follow(written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
                               .select("node", F.least("node", "to").alias("to")), "hook"))
        if total is None:
            total = hook.withColumnRenamed("to", "root")
        else:
            total = written(total.join(hook.withColumnRenamed("node", "root"), "root", "left")
                            .select("node", F.coalesce("to", "root").alias("root")), "roots")
        a, b = hook.select(F.col("node").alias("a"), F.col("to").alias("x")), hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = written(left.join(a, "a").join(b, "b").filter("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total

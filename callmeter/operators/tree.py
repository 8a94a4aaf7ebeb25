"""A shallow quantile tree over signs: every level is one DataFrame job over all nodes, signs and cuts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callmeter.functions.labels import ladder
from callmeter.operators.neighbours import complete_only
from callmeter.operators.ordered import running_sum, scan, with_slices
from callmeter.session import cut

c = F.col
QS = (0.1, 0.5, 0.9)
MIN_SIDE = 30
MISSING = "?"
TASK = ["session_key", "task_id"]


def _three(frequency: Column | None = None) -> Column:
    levels = F.array(*[F.lit(q) for q in QS])
    return F.percentile("y", levels) if frequency is None else F.percentile("y", levels, frequency)


def with_signs(tasks: DataFrame, labels: DataFrame, signs: list[str]) -> DataFrame:
    """tasks with `signs`, one (sign_no, label) per sign; a task without a label for it has '?'."""
    picks = [F.max(F.when(c("sign") == s, c("label"))).alias(f"s{i}") for i, s in enumerate(signs)]
    wide = labels.filter(c("sign").isin(*signs)).groupBy(*TASK).agg(*picks)
    cells = [F.struct(F.lit(i).alias("sign_no"), F.coalesce(f"s{i}", F.lit(MISSING)).alias("label")) for i in range(len(signs))]
    return tasks.join(wide, TASK, "left").withColumn("signs", F.array(*cells)).drop(*[f"s{i}" for i in range(len(signs))])


def best_splits(train: DataFrame) -> DataFrame:
    """(node, sign_no, left): the split of each node of `train` (node, y, signs) that lowers the quantile loss most.

    The labels of a sign stand in order of their median; a cut sends the first ones left. The cut after the last label is the
    node as it is, and wins every tie, so a node that nothing improves has no row. What is compared are counts per
    (node, sign, label, turns): labels are a dozen per sign, turns small whole numbers.
    """
    counts = cut(train.select("node", "y", F.explode("signs").alias("s")).groupBy("node", "s.sign_no", "s.label", "y").agg(F.count(F.lit(1)).alias("f")))
    sign = Window.partitionBy("node", "sign_no")
    medians = counts.groupBy("node", "sign_no", "label").agg(F.percentile("y", F.lit(0.5), c("f")).alias("median"))
    order = cut(medians.select("node", "sign_no", "label", F.row_number().over(sign.orderBy("median", "label")).alias("place"),
                               F.count(F.lit(1)).over(sign).cast("int").alias("labels")))
    side = ["node", "sign_no", "cut", "left", "labels"]
    sides = (counts.join(order, ["node", "sign_no", "label"]).withColumn("cut", F.explode(F.sequence(F.lit(1), c("labels"))))
             .groupBy("node", "sign_no", "cut", (c("place") <= c("cut")).alias("left"), "labels", "y").agg(F.sum("f").alias("f")))
    levels = sides.groupBy(*side).agg(F.sum("f").alias("n"), _three(c("f")).alias("q"))
    off = [c("y") - c("q")[i] for i in range(len(QS))]
    loss = sum((F.greatest(q * o, (q - 1) * o) for q, o in zip(QS, off)), F.lit(0.0))
    tried = (sides.join(levels, side).groupBy("node", "sign_no", "cut", "labels")
             .agg(F.round(F.sum(c("f") * loss), 4).alias("loss"), F.min("n").alias("least"))  # rounded: the order of a sum must not decide
             .withColumn("splits", c("cut") < c("labels")).filter(~c("splits") | (c("least") >= MIN_SIDE)))
    best = (tried.groupBy("node").agg(F.min(F.struct("loss", "splits", "sign_no", "cut")).alias("b")).filter("b.splits")
            .select("node", "b.sign_no", "b.cut"))
    return best.join(order, ["node", "sign_no"]).filter("place <= cut").groupBy("node", "sign_no").agg(F.collect_list("label").alias("left"))


def descend(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows one level down: 2 * node on the left, 2 * node + 1 on the right; rows of nodes without a split stay."""
    found = rows.join(F.broadcast(splits), "node", "left")  # one row a node: at most 2 ** depth
    label = F.filter("signs", lambda s: s["sign_no"] == c("sign_no"))[0]["label"]
    down = c("node") * 2 + F.when(F.array_contains("left", label), 0).otherwise(1)
    return found.withColumn("node", F.when(c("sign_no").isNull(), c("node")).otherwise(down)).drop("sign_no", "left")


def quantile_tree(tasks: DataFrame, labels: DataFrame, signs: list[str], rows: int | None = None, depths: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Trained on the oldest 70%, judged on the rest: all training tasks, each sign alone, trees of the given depths.

    `tasks`: (session_key, task_id, started_us, y). Long result (method, session_key, task_id, y, lo, mid, hi).
    """
    placed = scan(with_slices(tasks, [], "started_us", rows), [], ["started_us", "task_id"], n=running_sum(F.lit(1).cast("bigint"), inclusive=False))
    total = tasks.agg(F.count(F.lit(1)).alias("n")).scalar()
    old = c("n") < F.floor(total * 0.7)
    grown = cut(with_signs(placed.withColumn("old", old).drop("n", "slice"), labels, signs).withColumn("node", F.lit(1)))
    everything = grown.filter("old").agg(_three().alias("q"))  # one row

    named = F.element_at(F.array(*[F.lit(f"alone: {s}") for s in signs]), c("sign_no") + 1)
    long = grown.select(*TASK, "y", "old", F.explode("signs").alias("s")).select(*TASK, "y", "old", "s.*")
    slices = long.filter("old").groupBy("sign_no", "label").agg(F.count(F.lit(1)).alias("n"), _three().alias("q")).filter(c("n") >= MIN_SIDE).drop("n")
    alone = long.filter("NOT old").join(slices, ["sign_no", "label"], "left").withColumn("q", F.coalesce("q", everything.scalar()))
    parts = [alone.withColumn("method", named), grown.filter("NOT old").withColumns({"method": F.lit("all training tasks"), "q": everything.scalar()})]

    for depth in range(1, max(depths) + 1):
        grown = descend(grown, cut(best_splits(grown.filter("old"))))
        if depth in depths:
            leaves = grown.filter("old").groupBy("node").agg(_three().alias("q"))  # every leaf holds training tasks
            parts.append(grown.filter("NOT old").join(F.broadcast(leaves), "node").withColumn("method", F.lit(f"tree depth {depth}")))
    out = None
    for p in parts:
        p = p.select("method", *TASK, "y", c("q")[0].alias("lo"), c("q")[1].alias("mid"), c("q")[2].alias("hi"))
        out = p if out is None else out.unionByName(p)
    return out


def neighbour_labels(tasks: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """The median turns of a task's nearest earlier prompts as a label, 'no close prompts' without k of them.

    `top`: (task_id, near_id, ...) from the nearest-prompt join.
    """
    near = complete_only(top, "task_id", k).join(tasks.select(c("task_id").alias("near_id"), c("y").alias("near_y")), "near_id")
    med = near.groupBy("task_id").agg(F.percentile("near_y", F.lit(0.5)).alias("m"))
    label = F.concat(F.lit("close prompts: "), ladder(c("m"), [(2, "median 1-2"), (5, "median 3-5"), (10, "median 6-10")], "median 11+"))
    return tasks.join(med, "task_id", "left").select("session_key", "task_id", "started_us", F.lit("nearest prompts").alias("sign"),
                                                     F.coalesce(label, F.lit("no close prompts")).alias("label"), "y")

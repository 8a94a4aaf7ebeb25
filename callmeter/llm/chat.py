"""Reply trees to training conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.common import written
from callmeter.llm.sharding import slots

# Fixed values of the template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
END = "</turn>"


def escape(c: Column) -> Column:
    """Text in which no control string of the template can occur: a backslash goes before \\ # and :, and into </turn>."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(F.replace(c, F.lit("#"), F.lit("\\#")), F.lit(":"), F.lit("\\:"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, back) of nodes (node, parent): every node from a leaf to its root, `back` steps before the leaf.

    Self-joins by pointer doubling: after n of them a path reaches 2**n nodes back, so their number is the logarithm of the depth.
    A parent that isn't there makes its child a root; nodes on a cycle have no leaf and no path.
    """
    ids = nodes.select(F.col("node").alias("parent"))
    up = written(nodes.select("node", "parent").join(ids.withColumn("there", F.lit(True)), "parent", "left")
                 .select("node", F.when(F.col("there"), F.col("parent")).alias("parent")), "up")
    parents = up.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    paths = written(up.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).alias("back")), "paths")
    step, hops = written(up.filter("parent is not null").select("node", F.col("parent").alias("far")), "hop"), 1
    while not step.isEmpty():
        more = paths.join(step, "node").select("leaf", F.col("far").alias("node"), (F.col("back") + hops).alias("back"))
        paths = written(paths.union(more), "paths")
        if more.isEmpty():
            break
        step = written(step.join(step.select(F.col("node").alias("far"), F.col("far").alias("next")), "far").select("node", F.col("next").alias("far")), "hop")
        hops *= 2
    return paths


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, n_turns, formatted, loss_mask): each conversation's paths from root to leaf, best first.

    messages: (conv_id, node, parent, role, text, score); node is unique. A path's score is the mean of its nodes' (null: 0), ties to
    the smaller leaf; `branches` keeps so many of each conversation, None all. loss_mask: (start, length) in code points of each
    assistant text as it stands, escaped, in `formatted`. Null text or role is empty. No messages: no rows.
    """
    paths = leaf_paths(messages)
    held = messages.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                           F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    scored = written(paths.join(held.select("node", "conv_id", "score"), "node").groupBy("leaf")
                     .agg(F.first("conv_id").alias("conv_id"), F.avg("score").alias("score")), "scored")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    turns = (paths.join(ranked.select("leaf"), "leaf").join(held.select("node", "role", "text"), "node")
             .select("leaf", "back", (F.col("role") == "assistant").alias("loss"), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"),
                     escape(F.col("text")).alias("body")))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "loss", "head", "body")))
    made = turns.groupBy("leaf").agg(in_order.alias("turns"))
    start = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("mask")),
                        lambda s, t: F.struct((s["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(CLOSE)).cast("long").alias("at"),
                                              F.when(t["loss"], F.concat(s["mask"], F.array(F.struct(
                                                  (s["at"] + F.char_length(t["head"]) + 1).cast("long").alias("start"), F.char_length(t["body"]).cast("long").alias("length")))))
                                              .otherwise(s["mask"]).alias("mask")))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    made = made.select("leaf", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), start["mask"].alias("loss_mask"))
    return ranked.join(made, "leaf").select("conv_id", "leaf", "rank", "score", "n_turns", "formatted", "loss_mask")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(t: Column) -> Column:
        body = F.substring(t, len(OPEN) + 1, 2**31 - 1)
        role = F.regexp_extract(body, r"(?s)^((?:[^\\:]|\\.)*): ", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.char_length(role) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(turns, turn)


def thread_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages whose tree is a line: each answers the one before it by turn.

    Rows that tie in conv_id and turn go by role and text; repeated rows stay. A null turn comes first; rows with null conv_id are one conversation.
    """
    numbered = slots(conversations.select("conv_id", "turn", "role", "text", F.lit(0).alias("all")), "all", ["conv_id", "turn", "role", "text"])
    rows = written(numbered.select("conv_id", F.col("slot").alias("node"), "role", "text"), "messages")
    ends = written(rows.groupBy("conv_id").agg(F.min("node").alias("first")), "first-turns")
    return (rows.alias("r").join(ends.alias("e"), F.col("r.conv_id").eqNullSafe(F.col("e.conv_id")))
            .select("r.conv_id", "node", F.when(F.col("node") > F.col("first"), F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def digest(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted text and its mask."""
    f = format_trees(thread_messages(conversations)).select("conv_id", "formatted", "loss_mask", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"].cast("int"), m["length"].cast("int")))), "")
    return (f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                     loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"))

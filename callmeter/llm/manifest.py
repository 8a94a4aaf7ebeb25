"""A Merkle manifest of a dataset, labelled by nested intervals of leaf ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.llm.common import ascii_lower, small, written
from callmeter.llm.sharding import slots

#: Consecutive nodes that become one node of the next level.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(c: Column) -> Column:
    """A value with its length in front, so that no two rows have the same bytes; null is a bare dash."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def document_leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed): the hash of each row, and that of the tampered row, null where nothing was tampered with.

    Tampering lower-cases A-Z of the text of rows whose CRC-32 of the decimal doc_id is divisible by three; a null doc_id has none.
    Hashes are taken where the rows lie: no text is shuffled.
    """
    at = {f: framed(F.col(f)) for f in FIELDS}
    low = framed(ascii_lower(F.col("text")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return documents.select("doc_id", "lang", digest(*at.values()).alias("leaf"), F.when(hit, digest(*[at[f] for f in FIELDS[:-1]], low)).alias("changed"))


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows as leaves with the labels of level 0: lo is the rank in the group, [lo, hi) the interval covered, n the leaves of the group."""
    leaves = written(slots(rows, group, order), label)
    sizes = small(leaves.groupBy(group).agg(F.count("*").alias("n")))
    return leaves.join(sizes, group).withColumnRenamed("slot", "lo").withColumn("hi", F.col("lo") + 1)


def lifted(nodes: DataFrame, group: str, level: int) -> DataFrame:
    """The nodes of `level` over those of the level below that don't yet cover their whole group: each takes the run of up to
    FANOUT nodes whose intervals lie in its own."""
    width = FANOUT ** level
    run = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash")))
    return (nodes.filter("hi - lo < n").groupBy(group, F.expr(f"lo div {width} * {width}").alias("lo"))
            .agg(F.max("hi").alias("hi"), F.max("n").alias("n"), run.alias("kids"))
            .withColumn("hash", digest(F.array_join("kids.hash", ""))))


def tree(leaves: DataFrame, group: str) -> list[DataFrame]:
    """The levels from the leaves up: (group, lo, hi, n, hash, kids). In each group the last level with rows has one node, the top."""
    levels = [leaves.select(group, "lo", "hi", "n", "hash")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while FANOUT ** (len(levels) - 1) < most:
        levels.append(written(lifted(levels[-1], group, len(levels)), f"level{len(levels)}"))
    return levels


def tops(levels: list[DataFrame], group: str) -> DataFrame:
    """(group, hash) of the node that covers each group."""
    out = [level.filter("hi - lo = n").select(group, "hash") for level in levels]
    return out[0] if len(out) == 1 else out[0].unionByName(tops(levels[1:], group))


def attached(nodes: DataFrame, above: DataFrame, group: str, level: int) -> DataFrame:
    """nodes of the level below `level` with what their parent in `above` carries and, in front of its path, their own siblings.

    The parent is the node of `level` whose interval contains the node's: both lie in one bucket of FANOUT ** level ranks, so this is
    an equi join of at most FANOUT nodes a key. What the parent's interval holds besides the node's own are its siblings.
    """
    width = FANOUT ** level
    up = above.select(F.col(group).alias("__group"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("kids").alias("__kids"),
                      "path", "carried")
    held = nodes.join(up, (F.col(group) == F.col("__group")) & (F.expr(f"lo div {width}") == F.expr(f"__lo div {width}"))
                      & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi")))
    side = F.struct(F.expr("array_join(filter(__kids, k -> k.hi <= lo).hash, '')").alias("left"),
                    F.expr("array_join(filter(__kids, k -> k.lo >= hi).hash, '')").alias("right"))
    return held.withColumn("path", F.concat(F.array(side), "path")).drop("__group", "__lo", "__hi", "__kids")


def with_paths(leaves: DataFrame, levels: list[DataFrame], starts: DataFrame, group: str) -> DataFrame:
    """leaves with `path`, the siblings on the left and right of each ancestor from the leaf up, and `carried` from `starts`.

    starts holds (group, path, carried) for the top of each group.
    """
    starts = small(starts)
    above = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level] if level else leaves
        here = nodes.filter("hi - lo = n").join(starts, group)
        if above is not None:
            here = here.unionByName(attached(nodes.filter("hi - lo < n"), above, group, level + 1))
        above = here
    return above


def proofs(documents: DataFrame) -> DataFrame:
    """Each row of documents as a leaf of the manifest, its proof up to the root, and whether the row as stored still folds to the root.

    Returns doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root and verified. Null fields have a mark of their own and
    null lang is a lang, the first. Leaves ascend by doc_id (null first), then by hash; equal rows are leaves of their own. A lone
    row is its own subroot, a lone lang's subroot the root. Empty and very long texts are hashed like any other. No rows: none.
    Other columns are left out. Rows are ranked over ranges of equal size whatever lang they have, so a hot lang or row fills no task.
    """
    rows = written(document_leaves(documents).withColumn("__lang", framed(F.col("lang"))).withColumn("hash", F.col("leaf")), "leaves")
    leaves = ranked(rows, "__lang", ["lang", "doc_id", "leaf"], "ranked")
    levels = tree(leaves, "__lang")
    langs = rows.select("__lang", "lang").distinct().join(tops(levels, "__lang"), "__lang").withColumn("__all", F.lit(0))
    upper = ranked(langs, "__all", ["lang"], "subroots")
    over = tree(upper, "__all")
    root = tops(over, "__all").select("__all", F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("path"), F.col("hash").alias("carried"))
    starts = (with_paths(upper, over, root, "__all")
              .select("__lang", "path", F.struct(F.col("hash").alias("subroot"), F.col("carried").alias("root")).alias("carried")))
    out = with_paths(leaves, levels, written(starts, "starts"), "__lang")
    fold = F.aggregate("path", F.coalesce("changed", "leaf"), lambda h, s: digest(s["left"], h, s["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return (out.select("doc_id", "leaf", "carried.subroot", "carried.root", proof.alias("proof_sha256"), fold.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

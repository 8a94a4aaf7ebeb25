"""Session logs as lines: discovery, tolerant reading, sidecars, ledgers.

Layout: <root>/<project>/<session>.jsonl, with sub-agent logs in
<root>/<project>/<session>/subagents/<agent>.jsonl and a .meta.json beside each.
Files are read line by line and split by Spark; no file has to fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callmeter.session import cut

c = F.col
MAIN_FILE = r"/([^/]+)/([^/]+)\.jsonl$"
SUB_FILE = r"/([^/]+)/([^/]+)/subagents/([^/]+)\.jsonl$"
META_FILE = r"/([^/]+)/([^/]+)/subagents/([^/]+)\.meta\.json$"
# bump when parsing changes: sessions read by an older revision are read again
PARSER_REVISION = 1
ROW_MASK = (1 << 33) - 1


def _agent(stem: Column) -> Column:
    return F.regexp_replace(stem, "^agent-", "")


def _place(path: Column, source: str) -> dict[str, Column]:
    sub = path.rlike(SUB_FILE)
    project = F.when(sub, F.regexp_extract(path, SUB_FILE, 1)).otherwise(F.regexp_extract(path, MAIN_FILE, 1))
    session = F.when(sub, F.regexp_extract(path, SUB_FILE, 2)).otherwise(F.regexp_extract(path, MAIN_FILE, 2))
    return {
        "session_key": F.concat(F.lit(source + ":"), project, F.lit("/"), session),
        "session_id": session, "project_dir": project,
        "agent_file": F.when(sub, _agent(F.regexp_extract(path, SUB_FILE, 3))),
    }


def read_lines(spark: SparkSession, root: str, source: str = "log", sessions: DataFrame | None = None) -> DataFrame:
    """One row per file line, blank ones left out.

    `pos` orders the lines of a session: main file first, then sub-agent files by name; inside a file by
    block and by row (only compared within a file). `unterminated` marks the last line of a
    file that does not end with a newline, found by comparing the bytes read with the file's size.
    """
    raw = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
           .select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"),
                   c("_metadata.file_size").alias("size"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)).alias("row")))
    depth = raw.filter(c("file").rlike(SUB_FILE) | ~c("file").contains("/subagents/"))
    lines = depth.withColumns(_place(c("file"), source))
    if sessions is not None:
        lines = lines.join(sessions.select("session_key"), "session_key", "left_semi")
    files = lines.groupBy("file").agg(
        F.max(F.struct("block", "row")).alias("__last"), F.max("size").alias("__size"),
        F.sum(F.octet_length("value") + 1).alias("__read"))
    open_ended = files.filter(c("__read") == c("__size") + 1).select("file", "__last")
    marked = lines.join(open_ended, "file", "left")
    return marked.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(
        "session_key", "session_id", "project_dir", "agent_file", "file", "value",
        F.struct(F.when(c("agent_file").isNull(), 0).otherwise(1).alias("sub"), c("file").alias("file"),
                 c("block").alias("block"), c("row").alias("row")).alias("pos"),
        F.coalesce(F.struct("block", "row") == c("__last"), F.lit(False)).alias("unterminated"))


def read_sidecars(spark: SparkSession, root: str, source: str = "log") -> DataFrame:
    """Which tool use launched each sub-agent: (session_key, agent_id, tool_use_id, bad)."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").text(root, wholetext=True)
           .select("value", c("_metadata.file_path").alias("file")).filter(c("file").rlike(META_FILE)))
    v = F.expr("try_parse_json(value)")
    key = F.concat(F.lit(source + ":"), F.regexp_extract("file", META_FILE, 1), F.lit("/"), F.regexp_extract("file", META_FILE, 2))
    return raw.withColumn("v", v).select(
        key.alias("session_key"), _agent(F.regexp_extract("file", META_FILE, 3)).alias("agent_id"),
        F.expr("try_variant_get(v, '$.toolUseId', 'string')").alias("tool_use_id"), c("v").isNull().alias("bad"))


def signatures(spark: SparkSession, root: str, source: str = "log", revision: int = PARSER_REVISION) -> DataFrame:
    """One hash per session over its files' names, sizes and times; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(c("path").alias("file"), "length", "modificationTime"))
    placed = files.withColumn("as_log", F.regexp_replace("file", r"\.meta\.json$", ".jsonl")).filter(c("as_log").endswith(".jsonl"))
    rows = placed.withColumns(_place(c("as_log"), source))
    one = F.xxhash64("file", "length", "modificationTime").cast("decimal(20,0)")
    text = F.concat_ws("|", F.lit(str(revision)), F.sum(one).cast("string"), F.count(F.lit(1)).cast("string"))
    return rows.groupBy("session_key").agg(F.sha2(text, 256).alias("signature"))


def changed_sessions(found: DataFrame, ledger: DataFrame | None, force: bool = False) -> DataFrame:
    """Sessions whose signature is not in the ledger."""
    if force or ledger is None:
        return found
    return found.join(ledger.select("session_key", "signature"), ["session_key", "signature"], "left_anti")


def replace_sessions(path: str, new: DataFrame, touched: DataFrame, buckets: int = 64) -> None:
    """Put new rows of the touched sessions in place of the old ones, rewriting only their buckets."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("session_key"), F.lit(buckets)).cast("int")
    fresh = new.withColumn("session_bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # first write: no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        hit = touched.select("session_key", bucket.alias("session_bucket"))
        kept = (old.join(hit.select("session_bucket").distinct(), "session_bucket", "left_semi")
                .join(hit.select("session_key"), "session_key", "left_anti"))
        fresh = cut(fresh.unionByName(kept.select(fresh.columns)))  # read fully before its folders are rewritten
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_bucket").parquet(path)


def repeated_ids(lines: DataFrame) -> DataFrame:
    """Main files that hold lines of several session ids (resumed or forked sessions), with counts."""
    ids = (lines.filter(c("agent_file").isNull()).withColumn("v", F.expr("try_parse_json(value)"))
           .select("session_key", F.expr("try_variant_get(v, '$.sessionId', 'string')").alias("id")).filter(c("id").isNotNull()))
    counts = ids.groupBy("session_key", "id").agg(F.count(F.lit(1)).alias("lines"))
    several = counts.groupBy("session_key").agg(F.count(F.lit(1)).alias("ids")).filter("ids > 1")
    return counts.join(several, "session_key")


def sibling_files(lines: DataFrame, first: int = 30) -> DataFrame:
    """Other main files of the project whose first 30 lines carry a session's id: (session_key, sibling)."""
    from pyspark.sql import Window

    main = lines.filter(c("agent_file").isNull())
    head = (main.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).filter(c("rn") <= first)
            .withColumn("v", F.expr("try_parse_json(value)"))
            .select("project_dir", c("session_key").alias("sibling"), F.expr("try_variant_get(v, '$.sessionId', 'string')").alias("session_id"))
            .filter(c("session_id").isNotNull()).distinct())
    owners = main.select("project_dir", "session_id", "session_key").distinct()
    return owners.join(head, ["project_dir", "session_id"]).filter(c("sibling") != c("session_key")).select("session_key", "sibling")

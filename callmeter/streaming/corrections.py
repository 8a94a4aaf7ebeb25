"""Late data: calls kept as a table with a change log, corrected where a line or a result comes after its call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from callmeter.operators.cache import SECOND_US
from callmeter.session import scratch_path

c = F.col
KEY = ["session_key", "key"]
BUCKETS = 32
#: A piece of a call: a log line (`place` is its number; output null where the line was cut short), or what a sub-agent's
#: result says its output came to in the end (`final_output`, without a place).
PIECES = "session_key long, key long, place int, t_us long, model string, output long, final_output long"
CHANGES = "op string, late boolean, session_key long, key long, t_us long, model string, output long, lines long, exact boolean"
VERSION = ["t_us", "model", "output", "lines", "exact"]


def calls_of(pieces: DataFrame) -> DataFrame:
    """One row per call from all its pieces. This is the batch form, and what a correction computes anew for the calls it touches.

    A line that lands again replaces its cut version and is not counted twice; the largest output counts, a final one before any
    other. A call exists once one of its lines can be read.
    """
    line = c("place").isNotNull()
    whole = pieces.groupBy(*KEY, "place").agg(
        F.max("output").alias("output"), F.max("final_output").alias("final_output"), F.min("t_us").alias("t_us"),
        F.max_by("model", F.when(c("output").isNotNull(), c("output"))).alias("model"))
    readable = line & c("output").isNotNull()
    return whole.groupBy(*KEY).agg(
        F.min(F.when(line, c("t_us"))).alias("t_us"), F.min_by("model", F.when(readable, c("place"))).alias("model"),
        F.coalesce(F.max("final_output"), F.max("output")).alias("output"), F.count(F.when(readable, 1)).alias("lines"),
        F.max("final_output").isNotNull().alias("exact")).filter("lines > 0")


class CallStore:
    """Pieces, changes and event-time marks as tables of one folder per batch.

    `apply` is a foreachBatch sink. What a batch does depends on earlier batches alone and its folders are overwritten, so a batch that
    runs again, in part or in whole, leaves the same tables. A change is a retraction of the stored version and the
    new one; only calls with a piece in the batch are computed anew, and only those that come out different are written.
    Pieces lie in buckets of their call, so a batch reads the buckets it has pieces for.
    """

    def __init__(self, spark: SparkSession, path: str, delay_us: int = 600 * SECOND_US, buckets: int = BUCKETS):
        self.spark, self.path, self.delay_us, self.buckets = spark, path.rstrip("/"), delay_us, buckets
        self.schemas = {n: T.StructType.fromDDL(ddl) for n, ddl in (("pieces", PIECES), ("changes", CHANGES), ("marks", "high_us long"))}
        for name, schema in self.schemas.items():  # an empty batch, so that every table can be read from the start
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1" + ("/bucket=0" if name == "pieces" else ""))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def table(self, name: str) -> DataFrame:
        schema = T.StructType(list(self.schemas[name])).add("batch", "long")
        if name == "pieces":
            schema = schema.add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/batch={batch}")

    def versions(self, before: int | None = None) -> DataFrame:
        """The newest version of each call, of batches before `before`."""
        log = self.table("changes").filter("op = 'insert'")
        log = log if before is None else log.filter(c("batch") < before)
        return log.groupBy(*KEY).agg(F.max_by(F.struct(*VERSION), "batch").alias("version"), F.count(F.lit(1)).alias("versions"))

    def calls(self) -> DataFrame:
        """Stored calls: what `calls_of` gives for all pieces so far, and how many versions each has had."""
        return self.versions().select(*KEY, "version.*", "versions")

    def apply(self, pieces: DataFrame, batch: int) -> None:
        self._write(pieces.select(*self.schemas["pieces"].names).withColumn("bucket", self._bucket()).repartition("bucket"), "pieces", batch, "bucket")
        now = self.table("pieces").filter(c("batch") == batch)
        self._write(now.agg(F.max("t_us").alias("high_us")), "marks", batch)
        high = self.table("marks").filter(c("batch") < batch).agg(F.max("high_us")).first()[0]
        late = F.coalesce(F.min("t_us") < F.lit(None if high is None else high - self.delay_us).cast("long"), F.lit(False))
        touched = now.groupBy(*KEY).agg(late.alias("late"))
        hit = [r.bucket for r in now.select("bucket").distinct().collect()]  # at most `buckets`
        known = self.table("pieces").filter((c("batch") <= batch) & c("bucket").isin(hit)).join(touched, KEY, "left_semi")
        new = calls_of(known).select(*KEY, F.struct(*VERSION).alias("new"))
        old = self.versions(batch).join(touched, KEY, "left_semi").select(*KEY, c("version").alias("old"))
        differ = touched.join(new, KEY).join(old, KEY, "left").filter(~c("new").eqNullSafe(c("old")))
        steps = F.array(F.struct(F.lit("retract").alias("op"), c("old").alias("v")), F.struct(F.lit("insert").alias("op"), c("new").alias("v")))
        rows = differ.select(*KEY, "late", F.explode(steps).alias("s")).filter("s.v IS NOT NULL").select("s.op", "late", *KEY, "s.v.*")
        self._write(rows.select(*self.schemas["changes"].names), "changes", batch)


def correct(stream: DataFrame, store: CallStore, timeout_s: int | None = None) -> None:
    """Runs a stream of pieces into the store over what is there; `timeout_s` gives up earlier."""
    marks = scratch_path(store.spark, "corrections-state")
    query = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(store.apply).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"corrections still running after {timeout_s} s")

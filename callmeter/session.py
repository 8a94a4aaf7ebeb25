"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_CONF = "spark.callmeter.group.maxRows"
GROUP_ROWS_DEFAULT = 2_000_000


def group_rows(spark: SparkSession) -> int:
    """Most rows of one ordered group a single task may be given."""
    return int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a session whose tasks all run in this process (local mode, as in tests) may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="callmeter-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialize and cut the lineage in the shared folder, so a lost executor costs no re-run of the loop."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by key, whatever its size is taken for.

    The plan takes a cut table for a part of the files it began with. Lines made from a small file are many times larger, and would go whole
    through the driver as a broadcast.
    """
    return df.hint("merge")


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """As `cut`, for tables of some size: Parquet in the shared folder, compressed and with its true size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    mine = getattr(spark, "_lodestone_shared", None)
    if mine is None:
        mine = spark._lodestone_shared = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return mine


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back: its rows no longer change if a part is computed again."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, buckets: int, tag: str, name: str | None = None) -> DataFrame:
    """df written as a table whose rows lie in buckets by a column's hash: groups and joins on it need no shuffle of it."""
    spark, name = df.sparkSession, name or f"{tag}_{uuid.uuid4().hex}"
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").bucketBy(buckets, column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/lodestone/{name}").saveAsTable(name)
    return spark.table(name)


def added(df: DataFrame, name: str) -> DataFrame:
    """The table of that name, from stored_by, with df's rows, whose columns have its order, added to its buckets."""
    df.write.insertInto(name)
    return df.sparkSession.table(name)

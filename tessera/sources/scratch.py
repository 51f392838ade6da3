"""The folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A session on one machine may leave it unset and gets a folder of its own; on a cluster that is an error,
    as executors would not see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (given or _own()).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def write_down(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that several later steps share one run and a lost executor costs a reread."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

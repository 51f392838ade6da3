"""The tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; ``folder`` is any path that Spark reads."""
    if name not in NAMES:
        raise KeyError(name)
    return spark.read.parquet(f"{folder}/{name}.parquet")

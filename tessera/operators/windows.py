"""Ranking, running and session operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each partition's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def running_sum(df: DataFrame, *, key: str, time: str, tie: str, value: str, out: str, bucket: str = "day") -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its key, in order of time, then ``tie``.

    A window sees one bucket of a key's time; the totals of earlier buckets are carried over from one row a bucket, so a hot key is spread.
    Rows with a null key or time are left out.
    """
    cut = df.withColumn("_b", F.date_trunc(bucket, time))
    totals = cut.groupBy(key, "_b").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col(key), "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(key, "_b").orderBy(time, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    return cut.withColumn("_own", F.sum(value).over(inside)).join(totals, [key, "_b"]).withColumn(out, F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def sessions(df: DataFrame, *, key: str, time: str, gap: str, aggregates: list[Column]) -> DataFrame:
    """One row for each session: rows of a key of which each follows the last within ``gap``."""
    return df.groupBy(key, F.session_window(F.col(time).cast("timestamp"), gap).alias("_w")).agg(*aggregates).withColumn("session_start", F.col("_w.start").cast("timestamp_ntz")).drop("_w")

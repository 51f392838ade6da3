"""Joins that Spark has no single operator for, as compositions of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Largest side, in bytes as Spark estimates it, that is broadcast.
MOST_BROADCAST = 64 << 20


def small_side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if the optimizer's size estimate is within ``most``; else as it is, for a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def as_of_join(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, value: str, out: str, bucket_seconds: int = 86_400, strict: bool = False) -> DataFrame:
    """``left`` with ``out``: the ``value`` of the last row of ``right`` with the same key at or (``strict``) before the row's time.

    Both sides are one stream of events, cut into time buckets for each key: a window sees one bucket only, and what
    earlier buckets end with is carried over from one row a bucket. So a key with a third of all rows is
    spread over its buckets. Of right rows at one time the largest value counts. Times are timestamps; rows with a null key or time find nothing.
    """
    names = left.columns
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    l = left.select(F.struct(*names).alias("row"), F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))  # noqa: E741
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(1 if strict else 0).alias("side"), F.col(value).alias("v"))
    both = l.union(r).withColumn("b", F.floor(seconds(F.col("t")) / bucket_seconds))
    ends = r.withColumn("b", F.floor(seconds(F.col("t")) / bucket_seconds)).groupBy("k", "b").agg(F.max(F.struct("t", "v")).alias("end"))
    carried = both.select("k", "b").distinct().join(ends, ["k", "b"], "left")
    carried = carried.select("k", "b", F.last("end.v", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = W.partitionBy("k", "b").orderBy("t", "side", F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("last", F.last("v", ignorenulls=True).over(inside)).where("row is not null")
    found = seen.join(carried, seen["k"].eqNullSafe(carried["k"]) & seen["b"].eqNullSafe(carried["b"]), "left")
    return found.select("row.*", F.coalesce("last", "before").alias(out))


def range_join(points: DataFrame, spans: DataFrame, *, point: str, low: str, high: str, width: float, on: Column | None = None) -> DataFrame:
    """Rows of ``points`` and ``spans`` with low <= point < high (and ``on``), both numbers.

    Each span is listed in the buckets of ``width`` that it touches, so the join is an equality join on the bucket
    with a filter; choose a width near the spans' usual length.
    """
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    out = p.join(s, "_bucket").where(inside if on is None else inside & on)
    return out.drop("_bucket")


def salted_join(left: DataFrame, right: DataFrame, key: str, *, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join whose left side may have hot keys: each key is spread over ``salts``, the right side repeated for each of them.

    For inner, left, left_semi and left_anti joins. Where adaptive execution can split the skewed partition itself, prefer a plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    # the salt comes from the row, so a task that runs again deals the same way
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))  # noqa: E741
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    return l.join(r, [key, "_salt"], how).drop("_salt")

"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.joins import small_side
from tessera.sources.scratch import write_down


def exact_quantiles(df: DataFrame, by: str, wanted: dict[str, tuple[str, float]], *, buckets: int = 4096, more: dict[str, Column] | None = None) -> DataFrame:
    """(``by``, one column for each of ``wanted``): name -> (column, share), interpolated between neighbouring ranks; ``more`` are other aggregates by name.

    A quantile lies between two ranks of its group. One pass finds each group's ends and counts, a second counts the values in ``buckets`` equal ranges between the
    ends, and the running sum of these counts tells each rank's range; a third counts the distinct values of those ranges only. All passes combine before they shuffle, so no task holds a group, and none its
    distinct values: only those of one range, which a value that is repeated very often makes no larger. What a pass leaves is written down, so that its size is known when the next joins it: small enough, it is
    broadcast, and no row moves. Null values and NaN are left out; a group without values gets nulls. Null groups are a group.
    """
    fine = {name: F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double")) for name, (column, _) in wanted.items()}
    facts = [f(v).alias(f"{n}_{k}") for k, v in enumerate(fine.values()) for n, f in (("low", F.min), ("high", F.max), ("n", F.count))]
    ends = write_down(df.groupBy(F.col(by).alias("g")).agg(*facts, *[c.alias(f"more_{k}") for k, c in enumerate((more or {}).values())]), "quantile-ends")
    known = small_side(ends.drop(*[f"more_{k}" for k in range(len(more or {}))]))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(share)).alias("share"), F.col(f"v_{k}").alias("v"), F.col(f"low_{k}").alias("low"), F.col(f"high_{k}").alias("high"), F.col(f"n_{k}").alias("n")) for k, (_, share) in enumerate(wanted.values())]))
    bucket = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    rows = df.select(F.col(by).alias("own"), *[v.alias(f"v_{k}") for k, v in enumerate(fine.values())])
    placed = rows.join(known, F.col("own").eqNullSafe(F.col("g"))).select("g", each.alias("e")).select("g", "e.*").where("v is not null").select("g", "k", "share", "v", "n", bucket.alias("bucket"))
    at = (F.col("n") - 1) * F.col("share")
    counts = placed.groupBy("g", "k", "share", "n", "bucket").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("g", "k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("before", before).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).where("rank >= before and rank < before + c")
    ranges = ranked.groupBy(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("bucket").alias("bucket2")).agg(F.min("before").alias("before"), F.collect_set("rank").alias("ranks"))  # two ranks at most
    ranges = small_side(write_down(ranges, "quantile-ranges"))
    inside = placed.join(ranges, F.col("g").eqNullSafe(F.col("g2")) & (F.col("k") == F.col("k2")) & (F.col("bucket") == F.col("bucket2")))
    values = inside.groupBy("g", "k", "share", "bucket", "before", "ranks", "n", "v").agg(F.count("*").alias("c"))
    below = F.col("before") + F.coalesce(F.sum("c").over(W.partitionBy("g", "k", "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = values.withColumn("below", below).withColumn("rank", F.explode("ranks")).where("rank >= below and rank < below + c")
    weight = F.when(F.col("rank") == F.floor(at), 1 - (at - F.floor(at))).otherwise(at - F.floor(at))
    out = found.groupBy(F.col("g").alias("g2")).agg(*[F.sum(F.when(F.col("k") == k, F.col("v") * weight)).alias(name) for k, name in enumerate(wanted)])
    return ends.join(out, F.col("g").eqNullSafe(F.col("g2")), "left").select(F.col("g").alias(by), *wanted, *[F.col(f"more_{k}").alias(name) for k, name in enumerate(more or {})])

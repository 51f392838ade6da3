"""Sketches that are kept for each day and merged for any span of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes: 2**LG values or registers for counts of distinct keys, K for quantiles. The errors that three standard deviations allow, of counts and of ranks.
LG, K = 12, 200
COUNT_ERROR, RANK_ERROR = 3 / 2 ** (LG / 2), 0.03


def keep_daily(df: DataFrame, path: str, *, time: str, key: str, number: str) -> None:
    """Writes one row a day to ``path``: theta and HLL sketches of ``key``, a KLL sketch of ``number``, and how many rows there were.

    Partial sketches are merged before the shuffle, so a day with a third of all rows is a few kilobytes a task. Null keys and numbers are in no sketch; rows with a null time are left out.
    """
    day = F.date_trunc("day", time).cast("timestamp_ntz")
    kept = df.where(F.col(time).isNotNull()).groupBy(day.alias("day")).agg(F.theta_sketch_agg(key, LG).alias("theta"), F.hll_sketch_agg(key, LG).alias("hll"), F.kll_sketch_agg_double(F.col(number).cast("double"), K).alias("kll"), F.count("*").alias("n"))
    kept.write.parquet(path)


def merged(days: DataFrame, span: Column, name: str) -> DataFrame:
    """The sketches of all days of each ``span``, as one row."""
    return days.groupBy(span.alias(name)).agg(F.theta_union_agg("theta", LG).alias("theta"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"), F.sum("n").alias("n"))


def distinct_by_theta(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def common(a: Column, b: Column) -> Column:
    """About how many keys are in both; the error is a share of the union, not of the result."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_first(a: Column, b: Column) -> Column:
    """About how many keys are in ``a`` and not in ``b``."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def near(estimate: Column, exact: Column, of: Column, error: float = COUNT_ERROR) -> Column:
    """Whether an estimate is off by at most ``error`` of ``of``, or by one."""
    return F.abs(estimate - exact) <= F.greatest(of * error, F.lit(1.0))

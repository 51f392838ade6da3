"""Joins by two inequalities, counted for each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import write_down
from tessera.sources.workers import importable

#: Rows that a strip should hold, and strips in each direction at most: the grid of their counts, four times their square, goes through the driver.
STRIP_ROWS, MOST_STRIPS = 200_000, 512


def earlier_and_larger(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place, the sum of ``counts`` over places with a smaller x and a larger y.

    Rows are put in order of x, those of equal x in order of y, so that what counts stands before; then y's ranks are compared bit by bit from the highest: of those that agree so
    far, a row whose bit is 0 has before it, among those whose bit is 1, larger ones.
    """
    order = np.lexsort((y, x))
    rank, weight = np.unique(y, return_inverse=True)[1][order], counts[order].astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (bit + 1)
        at = np.argsort(group, kind="stable")
        ones = (rank[at] >> bit) & 1
        before = np.cumsum(np.where(ones, weight[at], 0))
        first = np.append(True, np.diff(group[at]) > 0)
        base = (before - np.where(ones, weight[at], 0))[first][np.cumsum(first) - 1]
        out[at] += np.where(ones, 0, before - base)
    back = np.empty_like(out)
    back[order] = out
    return back


def dominance_counts(left: DataFrame, right: DataFrame, *, left_by: tuple[str, str], right_by: tuple[str, str], out: str, strips: int | None = None) -> DataFrame:
    """``left`` with ``out``: how many rows of ``right`` have a smaller first and a larger second value. No pairs are made.

    Quantiles cut both values into strips; a quantile itself is a strip of its own, so that values that are repeated very often never fall into
    a strip with others and need no comparison in it. Rows of strips that lie wholly before and above are counted by the grid of strips; the rest are in the row's own strip in one direction or the other,
    each of them sorted by one task. Values are numbers or times; rows with a null or NaN count nothing and are not counted. All rows of ``left`` stay.
    """
    spark = left.sparkSession
    importable(spark)
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(df.schema[c].dataType, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(c)
    l = left.select(F.struct(*left.columns).alias("row"), *[number(left, c).cast("double").alias(n) for c, n in zip(left_by, "xy", strict=True)], F.lit(0).alias("w"))  # noqa: E741
    r = right.select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), *[number(right, c).cast("double").alias(n) for c, n in zip(right_by, "xy", strict=True)], F.lit(1).alias("w"))
    fine = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    both = write_down(l.where(fine).union(r.where(fine)), "dominance-rows")
    rest = l.where(f"not ({fine})").select("row.*", F.lit(0).cast("long").alias(out))
    n = strips or max(1, min(MOST_STRIPS, -(-both.count() // STRIP_ROWS)))
    shares = [k / n for k in range(1, n)]
    cuts = [np.unique(c) if c else np.zeros(0) for c in (both.approxQuantile(["x", "y"], shares, 1 / (8 * n)) if shares else ([], []))]

    @F.pandas_udf("i int, j int")
    def strip(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        # even between two cuts, odd at a cut
        return pd.DataFrame({name: np.searchsorted(c, v, "left") + np.searchsorted(c, v, "right") for name, c, v in zip("ij", cuts, (x.to_numpy(), y.to_numpy()), strict=True)}, dtype=np.int32)

    placed = write_down(both.withColumn("s", strip("x", "y")).select("row", "x", "y", "w", "s.i", "s.j"), "dominance-strips")
    grid = np.zeros((2 * len(cuts[0]) + 2, 2 * len(cuts[1]) + 2), np.int64)
    for g in placed.where("w = 1").groupBy("i", "j").agg(F.count("*").alias("n")).collect():
        grid[g["i"] + 1, g["j"]] = g["n"]
    grid = np.cumsum(np.cumsum(grid, axis=0)[:, ::-1], axis=1)[:, ::-1]  # [i, j]: strips before i, j and above
    shared = spark.sparkContext.broadcast(grid)

    @F.pandas_udf("long")
    def far(i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series(shared.value[i.to_numpy(), j.to_numpy() + 1])

    counted = placed.withColumn("found", F.when(F.col("w") == 0, far("i", "j")).otherwise(F.lit(0)).cast("long"))
    for own, first in (("i", "x"), ("j", "i")):
        counted = _inside(counted, own, first)
    return counted.where("w = 0").select("row.*", F.col("found").alias(out)).union(rest)


def _inside(rows: DataFrame, own: str, first: str) -> DataFrame:
    """Adds to ``found`` what is in the row's own strip, compared by ``first`` and y. Strips that are a single value hold nothing to find."""

    def run(table: pa.Table) -> pa.Table:
        x, y, w = (table.column(c).to_numpy() for c in (first, "y", "w"))
        more = earlier_and_larger(x, y, w) * (w == 0)
        at = table.schema.get_field_index("found")
        return table.set_column(at, table.schema.field(at), pa.array(table.column("found").to_numpy() + more, pa.int64()))

    return rows.where(f"{own} % 2 = 1").union(rows.where(f"{own} % 2 = 0").groupBy(own).applyInArrow(run, rows.schema))

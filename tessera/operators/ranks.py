"""Ranks, running sums and neighbours within groups of any size: a group is spread over ranges of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.joins import small_side
from tessera.sources.scratch import write_down


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _free(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def positions(df: DataFrame, by: list[str], order: list[Column], *, at: str = "at", of: str = "of", weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``at``, the place of each row in its group from 1, and ``of``, the group's rows; with ``weight``, the running and the whole sum of it.

    Rows are dealt in ranges of group and order, so a group with a third of all rows is a third of the tasks; each range counts its own rows, and what the ranges before have is added from one
    row a range and group. ``order`` should end with a tie-breaker: rows that are equal in it stand in any order, in one range. Null groups are a group.
    """
    if {at.lower(), of.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"{at} or {of} is a column already")
    place, own, before, total, where, *keys = _free(df, "_range", "_own", "_before", "_total", "_in", *[f"_group_{k}" for k in range(len(by))])
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [_col(c) for c in df.columns]
    dealt = df.withColumn(own, F.lit(1).cast("long") if weight is None else weight)
    dealt = write_down(dealt.repartitionByRange(n, *[_col(c) for c in by], *order).withColumn(place, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*[_col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(place).alias(where)).agg(F.sum(own).alias("s"))
    group = W.partitionBy(*keys)
    sums = sums.select(*keys, where, F.coalesce(F.sum("s").over(group.orderBy(where).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum("s").over(group).alias(total))
    sums = small_side(write_down(sums, "range-sums"))
    inside = W.partitionBy(*[_col(c) for c in by], place).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = dealt.withColumn(own, F.sum(own).over(inside))
    same = F.col(place) == F.col(where)
    for c, k in zip(by, keys, strict=True):
        same &= _col(c).eqNullSafe(F.col(k))
    return counted.join(sums, same).select(*names, (F.col(own) + F.col(before)).alias(at), F.col(total).alias(of))


def neighbours(df: DataFrame, by: list[str], at: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with a struct of one field for each of ``wanted``: name -> (column, shift), the column's value in the row that stands ``shift`` places before (after, if negative).

    The struct is null if there is no such row. Each row sends its values to the places that want them, so rows meet by group and place: no task sees a group, however large. ``at``
    has each place of a group once, as ``positions`` gives it.
    """
    send, place, row = _free(df, "_send", "_place", "_row")
    kinds = {c: df.schema[c].dataType for c, _ in wanted.values()}
    own = [F.lit(0).alias("to"), F.lit(True).alias("own"), *[F.lit(None).cast(kinds[c]).alias(f"v{k}") for k, (c, _) in enumerate(wanted.values())], *[F.lit(False).alias(f"h{k}") for k in range(len(wanted))]]
    sent = [F.struct(*own)]
    for k, (column, shift) in enumerate(wanted.values()):
        sent.append(F.struct(F.lit(shift).alias("to"), F.lit(False).alias("own"), *[(_col(column) if j == k else F.lit(None).cast(kinds[c])).alias(f"v{j}") for j, (c, _) in enumerate(wanted.values())], *[F.lit(j == k).alias(f"h{j}") for j in range(len(wanted))]))
    x = df.select(F.struct(*[_col(c) for c in df.columns]).alias(row), *[_col(c).alias(f"_by_{j}") for j, c in enumerate(by)], _col(at).alias(place), F.explode(F.array(*sent)).alias(send))
    x = x.select(F.when(F.col(f"{send}.own"), F.col(row)).alias(row), *[f"_by_{j}" for j in range(len(by))], (F.col(place) + F.col(f"{send}.to")).alias(place), send)
    met = x.groupBy(*[f"_by_{j}" for j in range(len(by))], place).agg(F.first(row, ignorenulls=True).alias(row), *[F.first(F.when(F.col(f"{send}.h{k}"), F.struct(F.col(f"{send}.v{k}").alias("value"))), ignorenulls=True).alias(f"n{k}") for k in range(len(wanted))])
    return met.where(F.col(row).isNotNull()).select(f"{row}.*", *[F.col(f"n{k}").alias(name) for k, name in enumerate(wanted)])


def tile(at: Column, of: Column, tiles: int) -> Column:
    """The tile of a place when a group is cut into ``tiles`` of sizes at most one apart, the larger first."""
    small, larger = F.floor(of / tiles), of % tiles
    head = larger * (small + 1)
    return F.when(at <= head, F.floor((at - 1) / (small + 1)) + 1).otherwise(larger + F.floor((at - 1 - head) / F.greatest(small, F.lit(1))) + 1).cast("int")


def within_before(df: DataFrame, by: list[str], time: Column, id_col: str, width: int, *, out: str) -> DataFrame:
    """(id_col, out): for each row how many rows of its group have a ``time`` (a whole number) from ``width`` before its own up to its own.

    Two probes a row, at either end, take their places among the rows. Rows with a null time are left out.
    """
    rows = df.select(*[_col(c).alias(f"g{k}") for k, c in enumerate(by)], time.cast("long").alias("t"), _col(id_col).alias("i")).where("t is not null")
    probes = F.array(F.struct((F.col("t") - width).alias("t"), F.lit(0).alias("kind")), F.struct(F.col("t").alias("t"), F.lit(1).alias("kind")), F.struct(F.col("t").alias("t"), F.lit(2).alias("kind")))
    keys = [f"g{k}" for k in range(len(by))]
    every = rows.withColumn("p", F.explode(probes)).select(*keys, "i", "p.t", "p.kind")
    placed = positions(every, keys, [F.asc("t"), F.asc("kind"), F.asc("i")], weight=(F.col("kind") == 1).cast("long"))
    return placed.groupBy(F.col("i").alias(id_col)).agg((F.max(F.when(F.col("kind") == 2, F.col("at"))) - F.max(F.when(F.col("kind") == 0, F.col("at")))).alias(out))

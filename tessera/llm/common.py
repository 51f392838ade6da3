"""What several operators share: the scratch folder, cut lineage, decisions on rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch
from tessera.sources.workers import importable

#: What ``materialise`` writes inside ``scratch_scope``.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths that ``materialise`` writes inside, in order, for ``clear`` to delete when nothing reads them any more."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``materialise`` has written."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends here.

    A lost executor then costs a reread, not a recomputation, and Python stages that
    several later steps need run once.
    """
    path = scratch(df.sparkSession, tag)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def lower_batches(spark: SparkSession, rows: int = 2000, mb: int = 4) -> None:
    """From now on this session hands Python workers batches of at most so many rows and MB (or one row); smaller settings stay.

    Long texts then cost a worker a few dozen MB at a time instead of 10,000 rows' worth. Workers also get this
    package's place on their path. For results that run later; what runs at once takes ``small_batches``.
    """
    importable(spark)
    was = int(spark.conf.get(_ROWS))
    if was <= 0 or was > rows:
        spark.conf.set(_ROWS, rows)
    spark.conf.set(_BYTES, min(mb << 20, int(spark.conf.get(_BYTES).rstrip("b"))))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 4) -> Iterator[None]:
    """``lower_batches`` for what runs inside; then the session's own settings are back."""
    was = {k: spark.conf.get(k) for k in (_ROWS, _BYTES)}
    lower_batches(spark, rows, mb)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def words_of_bits(slots: DataFrame, column: str) -> DataFrame:
    """The set of slot numbers in ``column`` as rows (word, mask) of 64 slots each.

    With slots below n there are at most n/64 rows, however many rows come in.
    """
    c = F.col(column)
    one = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    return slots.groupBy(F.shiftright(c, 6).alias("word")).agg(F.bit_or(one).alias("mask"))


def by_slots(docs: DataFrame, keys: DataFrame, key: Column, slots: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose ``key`` may be in ``keys``, the others); ``keys`` has one column.

    A bit set of fixed size, broadcast, decides, so nothing is shuffled: all rows with a key in ``keys`` are in the first
    part, with others that share their slot by chance. (With far more keys than slots all rows are.)
    """
    (name,), names = keys.columns, cols(docs)
    at, word, bits = (fresh(docs, f"_slot_{x}") for x in ("at", "word", "bits"))
    used = words_of_bits(keys.select(F.pmod(F.xxhash64(name), F.lit(slots)).alias("slot")), "slot").select(F.col("word").alias(word), F.col("mask").alias(bits))
    marked = docs.withColumn(at, F.pmod(F.xxhash64(key), F.lit(slots))).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(used), word, "left")
    hit = F.expr(f"coalesce({bits}, 0L) & shiftleft(1L, cast({at} & 63 as int))") != 0
    return marked.where(hit).select(*names), marked.where(~hit).select(*names)


def settle(docs: DataFrame, decided: DataFrame, k1: Column, k2: Column, first: Column, slots: int = 1 << 22) -> DataFrame:
    """``docs`` after decisions on rows by the two hashes ``k1`` and ``k2``: one row of each key that stays, none of one that goes.

    ``decided`` has (k1, k2, stays, n): keys that go, and keys of n > 1 equal rows of which the one with the least ``first`` stays (of
    equal ones, that with the least other columns). What it doesn't list stays, and only rows that it lists are shuffled (and by chance some
    others); keys of over a thousandth of these are broadcast, and equal rows are reduced to one before they are shuffled.
    """
    a, b, stays, n = (fresh(docs, f"_settle_{x}") for x in ("a", "b", "stays", "n"))
    names = cols(docs)
    decided = decided.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("stays").alias(stays), F.col("n").alias(n))
    some, rest = by_slots(docs, decided.select(a), k1, slots)
    total = decided.agg(F.sum(n)).first()[0] or 0
    some = hot_join(some.select(*names, k1.alias(a), k2.alias(b)), decided, [a, b], n, total, "left")
    order = F.struct(first, *[col(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    one = some.where(F.col(stays)).groupBy(a, b).agg(F.min_by(F.struct(*names), order).alias(n)).select(*[F.col(n)[c].alias(c) for c in docs.columns])
    return rest.union(some.where(F.col(stays).isNull()).select(*names)).union(one)


def hot_join(left: DataFrame, groups: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``left`` with ``groups``, which has each key once and in ``count`` how many of the ``total`` rows of ``left`` have it.

    Keys with over a thousandth of all rows, a thousand at most, are broadcast; so no hot key meets in one task.
    """
    more = [c for c in groups.columns if c not in on]
    is_hot, before = fresh(left, "_hot"), {c: fresh(left, f"_hot_{c}") for c in more}
    hot = groups.where(F.col(count) * 1000 > total).select(*on, F.lit(True).alias(is_hot), *[F.col(c).alias(before[c]) for c in more])
    marked = left.join(F.broadcast(hot), on, "left").select(*cols(left), is_hot, *before.values())
    rest = marked.where(F.col(is_hot).isNull()).select(*cols(left)).join(groups, on, how)
    return rest.select(*cols(left), *more).union(marked.where(F.col(is_hot)).select(*cols(left), *before.values()))


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), component being the smallest node.

    Alternating large-star and small-star steps: each is one aggregation by node, whose
    partial minima are combined before the shuffle, and one join, with hub nodes apart. Every round is written
    to the shared folder. It ends when each node with a smaller neighbour has no other one, which the aggregation
    that a round begins with tells; so edges that are stars already take no round. Self-loops and repeated edges do no harm;
    an edge with a null end is dropped. Raises if the rounds don't suffice (they grow with
    the logarithm of the longest path).
    """
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialise(e.distinct(), tag)
    loops, e = e.where("u = v").select("u"), e.where("u <> v")
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), tag)
        ends, apart = low.agg(F.sum("c"), F.count_if((F.col("m") < F.col("u")) & (F.col("c") > 1))).first()
        if not apart:
            nodes = low.select(F.col("u").alias("node"), F.col("m").alias("component"))
            if loops.isEmpty():
                return nodes
            return nodes.union(loops.join(low, "u", "left_anti").select("u", F.col("u")))
        large = hot_join(both, low, ["u"], "c", ends).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, tag)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = hot_join(large, low, ["u"], "c", ends // 2)
        links = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialise(small.select(F.explode(links).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), tag)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

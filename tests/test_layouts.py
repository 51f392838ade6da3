"""Clustered files, stored sketches, aggregates in two phases, functions over tables."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vectorized import FillGaps, least_squares, two_phase
from tessera.operators.sketches import COUNT_ERROR, RANK_ERROR, common, distinct_by_theta, keep_daily, merged, only_first, quantile
from tessera.sources.clustered import files_for, morton, read_clustered, versions, write_clustered
from tessera.sources.scratch import scratch


def test_morton_order():
    x, y = np.arange(256).repeat(256), np.tile(np.arange(256), 256)
    z = morton(x, y)
    plain = [int("".join(f"{a:08b}"[k] + f"{b:08b}"[k] for k in range(8)), 2) for a, b in zip(x[:3000], y[:3000], strict=True)]
    assert z[:3000].tolist() == plain and len(set(z.tolist())) == 1 << 16


@pytest.fixture
def lines(spark):
    """Times and numbers, a third of them alike, some null and NaN."""
    return spark.sql("SELECT id, CASE WHEN id % 97 = 0 THEN NULL WHEN id % 3 = 0 THEN timestamp_ntz'2024-03-01' ELSE timestamp_ntz'2024-01-01' + make_dt_interval(0, id * 7919 % 5000) END AS t, CASE WHEN id % 89 = 0 THEN double('nan') WHEN id % 83 = 0 THEN NULL ELSE double(id * 104729 % 10007) END AS v FROM range(20000)")


def test_clustered_files_are_skipped(spark, lines):
    path = scratch(spark, "clustered")
    assert write_clustered(lines, path, by=("t", "v"), files=64) == 0
    every = read_clustered(spark, path, lines.schema)
    assert sorted(map(str, every.collect())) == sorted(map(str, lines.collect()))
    total = len(files_for(spark, path, []))
    day = [("t", datetime(2024, 2, 1), datetime(2024, 2, 12))]
    low, cell = [("v", 100.0, 700.0)], [*day, ("v", 100.0, 700.0)]
    for where, share in ((day, 0.35), (low, 0.35), (cell, 0.12)):
        found = read_clustered(spark, path, lines.schema, where=where)
        want = lines
        for c, a, b in where:
            want = want.where(F.col(c).between(a, b))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count()
        assert len(files_for(spark, path, where)) <= share * total, where
    for where in ([("v", 9000.0, None)], [("v", None, 50.0)], [("t", None, datetime(2024, 1, 3))], [("v", None, None)], [("id", 5, 9)]):
        (c, a, b), got = where[0], read_clustered(spark, path, lines.schema, where=where)
        keep = F.col(c).isNotNull() & (F.lit(True) if a is None else F.col(c) >= a) & (F.lit(True) if b is None else F.col(c) <= b)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in lines.where(keep).collect())
    sizes = [r["count"] for r in every.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 0.1 * 20000  # the value of a third of the rows is in several files
    assert read_clustered(spark, path, lines.schema, where=[("v", -5.0, -1.0)]).count() == 0


def test_versions_and_failed_writes(spark, lines):
    path = scratch(spark, "clustered")
    write_clustered(lines.where("id < 100"), path, by=("t", "v"), files=2)
    with pytest.raises(Exception, match="stop here"):
        write_clustered(lines.withColumn("id", F.when(F.col("id") == 990, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")).cast("long")), path, by=("t", "v"), files=4)
    assert versions(spark, path) == [0] and read_clustered(spark, path, lines.schema).count() == 100
    assert write_clustered(lines.where("id < 300"), path, by=("v", "id"), files=3) == 1
    assert [read_clustered(spark, path, lines.schema, version=v).count() for v in (0, 1)] == [100, 300] and read_clustered(spark, path, lines.schema).count() == 300
    assert write_clustered(lines.limit(0), path, by=("t", "v"), files=2) == 2 and read_clustered(spark, path, lines.schema).count() == 0


def test_merged_sketches_are_within_their_bounds(spark):
    r = random.Random(1)
    rows = [(None if k % 500 == 0 else datetime(2024, 1, 1) + timedelta(hours=k % 960), None if k % 701 == 0 else r.randint(0, 12_000) + 6000 * (k % 960 // 480), None if k % 301 == 0 else r.gauss(0, 1) ** 3) for k in range(40_000)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k long, v double")
    path = scratch(spark, "sketches")
    keep_daily(df, path, time="t", key="k", number="v")
    days = spark.read.parquet(path)
    assert days.count() == 40
    halves = {x.half: x for x in merged(days, (F.col("day") >= F.lit(datetime(2024, 1, 21))).cast("int"), "half").collect()}
    keys, values = defaultdict(set), defaultdict(list)
    for t, k, v in rows:
        if t is not None:
            keys[int(t >= datetime(2024, 1, 21))] |= {k} - {None}
            values[int(t >= datetime(2024, 1, 21))] += [] if v is None else [v]
    both = merged(days, F.lit(0), "half").select(distinct_by_theta(F.col("theta")).alias("theta"), F.hll_sketch_estimate("hll").alias("hll"), "n").first()
    n = len(keys[0] | keys[1])
    assert abs(both.theta - n) <= COUNT_ERROR * n and abs(both.hll - n) <= COUNT_ERROR * n and both.n == sum(t is not None for t, *_ in rows)
    pair = spark.createDataFrame([(halves[0].theta, halves[1].theta)], "a binary, b binary").select(common(F.col("a"), F.col("b")).alias("both"), only_first(F.col("a"), F.col("b")).alias("only")).first()
    assert abs(pair.both - len(keys[0] & keys[1])) <= COUNT_ERROR * n and abs(pair.only - len(keys[0] - keys[1])) <= COUNT_ERROR * n
    for half, x in halves.items():
        for share in (0.01, 0.5, 0.9):
            (at,) = spark.createDataFrame([(x.kll,)], "kll binary").select(quantile(F.col("kll"), share)).first()
            assert abs(np.mean(np.array(values[half]) <= at) - share) <= RANK_ERROR
    empty = scratch(spark, "sketches")
    keep_daily(df.limit(0), empty, time="t", key="k", number="v")
    assert merged(spark.read.schema(days.schema).parquet(empty), F.lit(0), "half").count() == 0


@pytest.mark.parametrize("most", [1, 10_000])
def test_least_squares_in_two_phases(spark, most):
    r = np.random.default_rng(1)
    rows = []
    for key, n in (("a", 400), (None, 60), ("b", 3), ("c", 1)):
        x, z = r.normal(1e6, 1, n), r.integers(0, 9, n)
        for a, b, e in zip(x, z, r.normal(0, 0.1, n), strict=True):
            rows.append((key, "k", float(3 + 2 * a - b + e), float(a), int(b)))
    rows += [("a", "k", None, 5.0, 1), ("a", "k", float("nan"), 5.0, 1), ("d", "k", None, 1.0, 1), ("a", None, 1.0, 2.0, 3)]
    df = spark.createDataFrame(rows, "key string, _state string, y double, x double, z long").repartition(5)
    got = {(g.key, g._state): g for g in least_squares(df, ["key"], "y", ["x", "z"], most_groups=most).join(spark.createDataFrame([("k",)], "_state string")).collect()}
    assert {k for k, _ in got} == {"a", None, "b", "c", "d"}
    for key in ("a", None):
        own = np.array([x[2:] for x in rows if x[0] == key and x[2] is not None and x[2] == x[2]], float)
        off = own[:, 1:] - own[:, 1:].mean(axis=0)
        want = np.linalg.lstsq(off, own[:, 0] - own[:, 0].mean(), rcond=None)[0]
        assert (got[key, "k"].x, got[key, "k"].z) == pytest.approx(tuple(want), rel=1e-6) and got[key, "k"].n == len(own)
    assert (got["c", "k"].n, got["c", "k"].x) == (1, 0.0) and (got["d", "k"].n, got["d", "k"].intercept, got["d", "k"].x) == (0, None, None)
    assert least_squares(df.limit(0), ["key"], "y", ["x"]).count() == 0
    two = least_squares(df, ["key", "_state"], "y", ["x"])
    assert {(g.key, g._state) for g in two.collect()} == {(x[0], x[1]) for x in rows}


def test_two_phases_move_states_only(spark):
    df = spark.range(100_000).selectExpr("id % 3 AS k", "double(id) AS v").repartition(8)
    out = two_phase(df, ["k"], ["v"], partial=lambda v: np.array([len(v), v.max()]), merge=lambda a, b: np.array([a[0] + b[0], max(a[1], b[1])]), finish=lambda s: [int(s[0]), float(s[1])], schema="n long, most double")
    assert sorted(map(tuple, out.collect())) == [(0, 33334, 99999.0), (1, 33333, 99997.0), (2, 33333, 99998.0)]


def test_gaps_are_filled(spark):
    at = lambda k: date(2024, 1, 1) + timedelta(days=k)
    rows = [(1, at(0), 5, "x"), (1, at(3), 7, "y"), (1, at(3), 8, "z"), (2, at(9), 1, "x"), (None, at(1), 1, None), (None, at(2), 2, None), (3, None, 4, "n"), (3, at(0), 1, "o"), (3, at(2), 1, "p")]
    df = spark.createDataFrame(rows, "user long, day date, n long, note string")
    got = FillGaps(df.asTable().partitionBy("user").orderBy("day", "n"), F.lit("day"), F.lit("n"))
    assert got.columns == ["user", "day", "n", "note", "filled"]
    want = [(*x, False) for x in rows] + [(1, at(1), 0, "x", True), (1, at(2), 0, "x", True), (3, at(1), 0, "o", True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert FillGaps(df.limit(0).asTable().partitionBy("user").orderBy("day"), F.lit("day"), F.lit("n")).count() == 0
    with pytest.raises(Exception, match="the table has no"):
        FillGaps(df.asTable().partitionBy("user").orderBy("day"), F.lit("day"), F.lit("none")).collect()

"""Places, neighbours, tiles and frames within groups that are spread over ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.quantiles import exact_quantiles
from tessera.operators.ranks import neighbours, positions, tile, within_before


@pytest.fixture
def rows():
    r = random.Random(1)
    return [(k, r.choice(["hot", "hot", "hot", "b", None, f"k{k % 7}"]), r.choice([None, 1.0, 1.0, r.uniform(-9, 9)]), r.choice([None, "x", "y"])) for k in range(400)] + [(400, "alone", 5.0, "z")]


def grouped(rows, key):
    out = {}
    for x in sorted(rows, key=key):
        out.setdefault(x[1], []).append(x)
    return out


by_value = lambda x: (x[2] is not None, x[2] or 0, x[0])


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_positions_and_tiles(spark, rows, ranges):
    df = spark.createDataFrame(rows, "id long, `a.b` string, v double, s string")
    got = positions(df, ["a.b"], [F.asc("v"), F.asc("id")], ranges=ranges).withColumn("tile", tile(F.col("at"), F.col("of"), 4)).collect()
    want = {}
    for own in grouped(rows, by_value).values():
        cuts = [len(own) // 4 + (k < len(own) % 4) for k in range(4)]
        tiles = [k + 1 for k, n in enumerate(cuts) for _ in range(n)]
        want |= {x[0]: (k + 1, len(own), tiles[k]) for k, x in enumerate(own)}
    assert {g.id: (g["at"], g["of"], g.tile) for g in got} == want and len(got) == len(rows)
    down = positions(df, ["a.b"], [F.desc_nulls_last("v"), F.asc("id")], weight=F.when(F.col("s") == "x", 2).otherwise(0).cast("long"), at="sum", of="all", ranges=ranges)
    want = {}
    for own in grouped(rows, lambda x: (x[2] is None, -(x[2] or 0), x[0])).values():
        total = 0
        for x in own:
            total += 2 * (x[3] == "x")
            want[x[0]] = total
    assert {g.id: g["sum"] for g in down.collect()} == want


def test_neighbours(spark, rows):
    df = positions(spark.createDataFrame(rows, "id long, key string, v double, s string"), ["key"], [F.asc("v"), F.asc("id")], ranges=5)
    got = {g.id: (g.one, g.far, g.next) for g in neighbours(df, ["key"], "at", {"one": ("s", 1), "far": ("v", 3), "next": ("id", -2)}).collect()}
    want = {}
    for own in grouped(rows, by_value).values():
        at = lambda k, c: (own[k][c],) if 0 <= k < len(own) else None  # noqa: B023, E731
        want |= {x[0]: (at(k - 1, 3), at(k - 3, 2), at(k + 2, 0)) for k, x in enumerate(own)}
    assert {k: tuple(None if x is None else (x.value,) for x in v) for k, v in got.items()} == want


def test_frames_of_a_width(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["hot", "hot", None, "b"]), r.choice([None, r.randint(0, 60), 30])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, key string, t long")
    got = {g.id: g.n for g in within_before(df, ["key"], F.col("t"), "id", 10, out="n").collect()}
    assert got == {i: sum(k == key and u is not None and t - 10 <= u <= t for _, k, u in rows) for i, key, t in rows if t is not None}


def test_nothing_and_clashing_names(spark, rows):
    df = spark.createDataFrame(rows, "id long, _range string, _own double, _group_0 string")
    assert {g["of"] for g in positions(df, ["_range"], [F.asc("id")], ranges=3).where("_range = 'alone'").collect()} == {1}
    assert positions(df.limit(0), ["_range"], [F.asc("id")]).count() == 0
    assert neighbours(positions(df.limit(0), ["_range"], [F.asc("id")]), ["_range"], "at", {"x": ("id", 1)}).count() == 0
    with pytest.raises(ValueError):
        positions(df, ["_range"], [F.asc("id")], at="id")


def test_quantiles_read_three_times_and_move_no_rows(spark):
    df = spark.createDataFrame([(k % 3, float(k)) for k in range(300)], "g long, v double")
    out = exact_quantiles(df, "g", {"m": ("v", 0.5), "q": ("v", 0.25)}, more={"n": F.count("*")})
    assert sorted(map(tuple, out.collect())) == [(g, 148.5 + g, 74.25 + g, 100) for g in range(3)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan

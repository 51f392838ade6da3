"""Spans with spans, two inequalities, heavy hitters, walks: against plain loops, with nulls, ties, skew and empty tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators.chains import chains
from tessera.operators.dominance import dominance_counts, earlier_and_larger
from tessera.operators.frequent import heavy_hitters, reduced
from tessera.operators import overlaps
from tessera.operators.overlaps import overlap_join, overlap_totals
from tessera.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bin_rows", [1, 20, 1_000_000])
def test_overlapping_spans(spark, bin_rows):
    r = random.Random(1)
    length = lambda: r.choice([0, 1, 1, 2, 3, 8, 9, 100, 1000, -3])
    left = [(k, a, a + length()) for k in range(150) for a in [r.randint(-300, 300)]] + [(900, -(10**15), 10**15), (901, None, 5), (902, 5, None), (903, 7, 8), (903, 7, 8)]
    right = [(k, a, a + length()) for k in range(120) for a in [r.randint(-300, 300)]] + [(900, -(2**40), 2**41), (901, 7, 8)] + [(950, 0, 64)] * 60
    l, d = spark.createDataFrame(left, "k long, a long, b long"), spark.createDataFrame(right, "m long, c long, d long")  # noqa: E741
    joined = overlap_join(l, d, left_span=("a", "b"), right_span=("c", "d"), bin_rows=bin_rows)
    want = Counter((*x, *y) for x in left for y in right if None not in (*x, *y) and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert Counter(map(tuple, joined.collect())) == want and max(want.values()) > 1
    assert not any(x in plan(joined) for x in ("NestedLoop", "Cartesian", "Join Cross"))
    some = overlap_join(l, d, left_span=("a", "b"), right_span=("c", "d"), on=l["k"] != d["m"])
    assert some.count() == sum(n for x, n in want.items() if x[0] != x[3])


def test_spans_of_nothing_and_clashing_names(spark):
    l, e = spark.createDataFrame([(1, 0, 9)], "k long, a long, b long"), spark.createDataFrame([], "m long, c long, d long")  # noqa: E741
    assert overlap_join(l, e, left_span=("a", "b"), right_span=("c", "d")).count() == 0
    assert overlap_join(e, l, left_span=("c", "d"), right_span=("a", "b")).count() == 0
    with pytest.raises(ValueError):
        overlap_join(l, l, left_span=("a", "b"), right_span=("a", "b"))


def test_earlier_and_larger():
    r = np.random.default_rng(1)
    for n, top in [(0, 5), (1, 5), (200, 3), (300, 1000)]:
        x, y, w = r.integers(0, top, n), r.integers(0, top, n), r.integers(0, 2, n)
        assert earlier_and_larger(x, y, w).tolist() == [int(w[(x < a) & (y > b)].sum()) for a, b in zip(x, y, strict=True)]


@pytest.mark.parametrize("strips", [1, 2, 7, 60])
def test_two_inequalities(spark, strips):
    r = random.Random(2)
    value = lambda: r.choice([None, float("nan"), 1.0, 1.0, 1.0, r.uniform(-5, 5), float(r.randint(-3, 3))])
    left = [(k % 90, value(), value()) for k in range(120)]
    right = [(value(), value()) for _ in range(200)]
    got = dominance_counts(spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "p double, q double"), left_by=("x", "y"), right_by=("p", "q"), out="n", strips=strips)
    ok = lambda *v: all(a is not None and a == a for a in v)
    want = Counter((k, str(x), str(y), sum(ok(x, y, p, q) and p < x and q > y for p, q in right)) for k, x, y in left)
    assert Counter((g.k, str(g.x), str(g.y), g.n) for g in got.collect()) == want
    assert not any(x in plan(got) for x in ("NestedLoop", "Cartesian"))


def test_two_inequalities_of_times_and_of_nothing(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(id % 5) AS t, id % 7 AS v FROM range(70)")
    rows = df.collect()
    got = {g.id: g.n for g in dominance_counts(df, df, left_by=("t", "v"), right_by=("t", "v"), out="n", strips=3).collect()}
    assert got == {a.id: sum(b.t < a.t and b.v > a.v for b in rows) for a in rows}
    none = df.limit(0)
    assert dominance_counts(none, df, left_by=("t", "v"), right_by=("t", "v"), out="n").count() == 0
    assert {g.n for g in dominance_counts(df, none, left_by=("t", "v"), right_by=("t", "v"), out="n").collect()} == {0}


def test_heavy_hitters(spark):
    r = random.Random(3)
    keys = [r.choice(["hot", "hot", "warm", None, f"k{r.randint(0, 10**6)}", f"k{r.randint(0, 10**6)}"]) for _ in range(3000)] + [f"late{k}" for k in range(2000)] + ["exact"] * 50
    r.shuffle(keys)
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, n long").repartition(5)
    count = Counter(keys)
    for share in (0.5, 0.1, 0.01, 50 / len(keys), 1.0):
        assert {x.key: x.times for x in heavy_hitters(df, "key", share, out="times").collect()} == {k: n for k, n in count.items() if n >= share * len(keys)}, share
    assert heavy_hitters(df.limit(0), "key", 0.1).count() == 0
    assert {(x.id, x.n) for x in heavy_hitters(spark.range(10), "id", 0.05).collect()} == {(k, 1) for k in range(10)}
    with pytest.raises(ValueError):
        heavy_hitters(df, "key", 0)


def test_counters_are_bounded():
    r = np.random.default_rng(4)
    stream = r.zipf(1.3, 20_000).clip(max=5000)
    keys, counts, lost, most = pa.array([], pa.int64()), np.zeros(0, np.int64), 0, 20
    for chunk in np.split(stream, 40):
        merged = Counter(dict(zip(keys.to_pylist(), counts.tolist(), strict=True))) + Counter(chunk.tolist())
        keys, counts, off = reduced(pa.array(list(merged), pa.int64()), np.array(list(merged.values())), most)
        lost += off
        assert len(keys) <= most
    kept, true = dict(zip(keys.to_pylist(), counts.tolist(), strict=True)), Counter(stream.tolist())
    assert lost <= len(stream) / (most + 1) and all(true[k] - lost <= kept.get(k, 0) <= true[k] for k in true)


def test_chains(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 3), (30, 31), (31, 32), (32, 31), (40, 40), (50, None), (None, 51), (60, 61)] + [(100 + k, 101 + k) for k in range(12)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {(1, 4, 3, "end"), (10, 11, 1, "end"), (20, 4, 2, "end"), (30, 31, 3, "loop"), (60, 61, 1, "end"), (100, 112, 12, "end")}
    assert set(map(tuple, chains(df).collect())) == want
    assert {tuple(x) for x in chains(df, most=5).collect()} == want - {(100, 112, 12, "end")} | {(100, 105, 5, "bound")}
    assert {tuple(x) for x in chains(df, most=12).collect()} == want
    assert chains(df.limit(0)).count() == 0


def test_no_side_of_a_span_join_is_broadcast(spark):
    # a side is listed once for each width of the other, which Spark's estimate leaves out: it would pass whole through the driver
    l = spark.range(500).selectExpr("id as k", "id * 3 as a", "id * 3 + cast(pow(2, id % 30) as long) as b")  # noqa: E741
    joined = overlap_join(l, l.toDF("m", "c", "d"), left_span=("a", "b"), right_span=("c", "d"))
    assert joined.count() > 0
    joined.collect()
    assert "Broadcast" not in plan(joined) and "SortMergeJoin" in plan(joined)


def totals(spans):
    """What ``overlap_totals`` should give, by plain loops."""
    out = {}
    fine = [(k, a, b) for k, a, b in spans if None not in (k, a, b) and a < b]
    for k, a, b in fine:
        for m, c, d in fine:
            if k != m and a < d and c < b:
                pairs, partners, together = out.setdefault(k, (0, set(), 0))
                out[k] = (pairs + 1, partners | {m}, together + min(b, d) - max(a, c))
    return {k: (pairs, len(partners), together) for k, (pairs, partners, together) in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_totals_of_overlaps_in_numpy(monkeypatch, small):
    if small:  # tables, lookups and packs of a few
        for name, n in {"LOOKUPS": 7, "MARKS": 20, "SORTED": 5, "AT_ONCE": 3}.items():
            monkeypatch.setattr(overlaps, name, n)
    r = random.Random(5)
    for keys, rows, top in [(1, 1, 1), (2, 40, 50), (9, 60, 3), (30, 80, 1000), (300, 300, 10**5), (40, 300, 10**15)]:
        draw = lambda: [(r.randrange(keys) * 7 - 3, a, a + r.choice([1, 1, 2, r.randint(1, top), 10 * top])) for _ in range(rows) for a in [r.randint(-top, top)]]  # noqa: B023, E731
        one, two = draw(), [(k + 1, a, b) for k, a, b in draw()]  # no key in common
        side = lambda rows: overlaps._unpacked([overlaps._packed(*np.array(sorted(part, key=lambda x: x[1])).T) for part in (rows[:20], rows[20:]) if part])
        found = [f for args in ((side(one), side(two)), (side(one),), (side(two),)) for f in overlaps._meetings(*args)]
        got = {}
        for key, *row in (x for f in found for x in zip(*(c.tolist() for c in f), strict=True)):
            got[key] = tuple(map(sum, zip(row, got.get(key, (0, 0, 0)), strict=True)))
        assert got == totals(one + two)


@pytest.mark.parametrize("part_rows", [None, 1, 100])
def test_totals_of_overlaps(spark, part_rows):
    r = random.Random(6)
    length = lambda: r.choice([0, 1, 1, 2, 3, 9, 100, 1000, -3])
    spans = [(r.choice([None, 7, *range(-20, 40)]), a, a + length()) for _ in range(300) for a in [r.randint(-2000, 2000)]]
    spans += [(-99, -(10**15), 10**15), (2**62, None, 5), (2**62, 5, None), (77, 8, 9), (77, 8, 9), (500, 10**16, 10**17)]
    if part_rows == 1:
        spans = spans[-14:]  # a task for each two
    found = overlap_totals(spark.createDataFrame(spans, "k long, a long, b long"), key="k", span=("a", "b"), part_rows=part_rows)
    assert {x.k: (x.pairs, x.partners, x.together) for x in found.collect()} == totals(spans)
    assert overlap_totals(spark.createDataFrame([], "k long, a long, b long"), key="k", span=("a", "b")).count() == 0


def test_pairs_of_overlapping_sessions_are_not_shuffled(spark, tmp_path):
    # 400 users that are all active together: 160,400 pairs of users, each of which was shuffled to count partners
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id div 400) AS ts, id % 400 AS user_id FROM range(2000)").write.parquet(f"{tmp_path}/events.parquet")
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before = sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size()))
    found = catalogue.QUERIES["overlapping_sessions"](spark, str(tmp_path))
    n, us = 400, 4 * 60 * 10**6
    assert {tuple(x) for x in found.collect()} == {(k, n, n, n * us) for k in range(-1, n)}
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    written = sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size())) - before
    assert written < 200_000

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.joins import as_of_join, range_join, salted_join, small_side
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.windows import running_sum, sessions, top_k
from tessera.plans import catalogue
from tessera.sources.files import load, save
from tessera.sources.scratch import scratch

START = datetime(2024, 1, 1)


def events(spark, seed, n=300):
    """Few keys, equal times, null keys and times."""
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), None if r.random() < 0.03 else START + timedelta(hours=r.randint(0, 150)), float(r.randint(1, 9))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, key string, t timestamp_ntz, v double")


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join(spark, strict):
    left, l = events(spark, 1)  # noqa: E741
    right, r = events(spark, 2)
    got = {x.id: x.found for x in as_of_join(l, r, key="key", left_time="t", right_time="t", value="id", out="found", strict=strict).collect()}
    assert len(got) == len(left)
    for i, key, t, _ in left:
        before = [(u, j) for j, k, u, _ in right if k == key and key is not None and u is not None and t is not None and (u < t or (u == t and not strict))]
        assert got[i] == (max(before)[1] if before else None)


def test_range_join(spark):
    r = random.Random(3)
    points = [(k, r.uniform(-50, 50)) for k in range(200)]
    spans = [(k, a, a + r.choice([0, 1, 30])) for k in range(60) for a in [r.uniform(-50, 50)]]
    got = range_join(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, lo double, hi double"), point="x", low="lo", high="hi", width=7.0)
    assert sorted((x.p, x.s) for x in got.collect()) == sorted((p, s) for p, x in points for s, lo, hi in spans if lo <= x < hi)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    left = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(90)], "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "key string, w long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(salted_join(left, right, "key", how=how)) == rows(left.join(right, "key", how))
    with pytest.raises(ValueError):
        salted_join(left, right, "key", how="full")


def test_small_side_is_checked(spark):
    assert "ResolvedHint (strategy=broadcast)" in small_side(spark.range(10))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in small_side(spark.range(10), most=8)._jdf.queryExecution().analyzed().toString()


def test_running_sum(spark):
    rows, df = events(spark, 4)
    rows = [x for x in rows if x[1] and x[2]]
    got = {x.id: x.s for x in running_sum(df.where("key is not null and t is not null"), key="key", time="t", tie="id", value="v", out="s").collect()}
    assert got == {i: sum(w for j, k, u, w in rows if k == key and (u, j) <= (t, i)) for i, key, t, _ in rows}


def test_sessions_and_top_k(spark):
    rows = [(1, "a", START, 1.0), (2, "a", START + timedelta(minutes=29), 2.0), (3, "a", START + timedelta(minutes=59), 3.0), (5, "a", START + timedelta(minutes=90), 0.5), (4, "b", START, 9.0)]
    df = spark.createDataFrame(rows, "id long, key string, t timestamp_ntz, v double")
    got = sessions(df, key="key", time="t", gap="30 minutes", aggregates=[F.count("*").alias("n")])
    assert sorted((x.key, x.session_start, x.n) for x in got.collect()) == [("a", START, 3), ("a", START + timedelta(minutes=90), 1), ("b", START, 1)]
    assert {(x.id, x.rank) for x in top_k(df, 1, ["key"], [F.desc("v")]).collect()} == {(3, 1), (4, 1)}


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_exact_quantiles(spark, buckets):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", None, "b"]), r.choice([None, 7.0, 7.0, r.uniform(-3, 9)])) for _ in range(200)] + [("c", 1.0), ("d", None), ("e", 2.0), ("e", 2.0)]
    got = {x.key: (x.m, x.q) for x in exact_quantiles(spark.createDataFrame(rows, "key string, v double"), "key", {"m": ("v", 0.5), "q": ("v", 0.9)}, buckets=buckets).collect()}
    assert set(got) == {k for k, _ in rows} and got["d"] == (None, None)
    for key, found in got.items():
        values = [v for k, v in rows if k == key and v is not None]
        if values:
            assert found == pytest.approx(tuple(np.quantile(values, [0.5, 0.9])))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    with pytest.raises(ValueError):
        scratch(N(conf=N(get=lambda *_: None), sparkContext=N(master="spark://host:7077")), "t")
    assert scratch(N(conf=N(get=lambda *_: None), sparkContext=N(master="local[4]")), "t").count("/t-") == 1


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files(spark, kind):
    rows = [(1, " a,\"b\" ", START, 1.5), (2, "", START, None), (3, None, None, -0.0)]
    df = spark.createDataFrame(rows, "id long, s string, t timestamp_ntz, v double")
    path = scratch(spark, "t")
    save(df, path, kind)
    assert sorted(map(tuple, load(spark, path, df.schema, kind).collect())) == rows
    with pytest.raises(ValueError):
        save(df, path, "xls")


def test_lateral_orders_are_ranked_by_price(spark):
    folder = scratch(spark, "lateral")
    spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    orders = [(None, 1, 5.0), (7, 1, 5.0), (6, 1, 5.0), (5, 1, None), (10, 2, None), (11, 2, 1.0), (12, 2, 9.0), (20, 3, 4.0), (30, None, 4.0), (31, 4, 4.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(4).write.parquet(f"{folder}/orders.parquet")
    found = catalogue.lateral_top_orders(spark, folder)
    assert sorted(map(tuple, found.collect())) == [(1, 6), (1, 7), (2, 11), (2, 12), (3, 20), (3, 20)]
    # an order that only a sort before the shuffle gives is lost when blocks come from several executors
    ranks = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", found._jdf.queryExecution().executedPlan().toString())
    assert ranks and all("o_totalprice" in r and "o_orderkey" in r for r in ranks)

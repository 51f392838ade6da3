from pathlib import Path

import pytest
from pyspark.errors import PythonException
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.sources.records import _at, commits, in_ranges, may_match, read_records, records, stream_records, write_records
from tessera.sources.scratch import scratch

SCHEMA = "id long, k string, t timestamp_ntz, v double, a array<int>"


@pytest.fixture
def rows(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 50 = 0 then null else concat('k', lpad(id, 4, '0')) end as k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) as t", "case when id % 7 = 0 then double('nan') else id / 3 end as v", "array(int(id), null) as a")
    assert df.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    return df


def opened(df):
    return df.rdd.getNumPartitions()


def test_round_trip_and_skipping(spark, rows):
    path = scratch(spark, "rec")
    write_records(rows.repartitionByRange(10, "id"), path, keys=["id", "k", "v", "t"])
    df = read_records(spark, path)
    assert df.schema == rows.schema and sorted(map(str, df.collect())) == sorted(map(str, rows.collect()))
    assert opened(df) == 10
    cases = [([("id", "=", 5)], "id = 5", 1), ([("id", ">=", 950)], "id >= 950", 1), ([("id", "in", [1, 999])], "id in (1, 999)", 2), ([("id", ">=", 150), ("id", "<=", 160)], "id between 150 and 160", 1), ([("k", "starts with", "k095")], "k like 'k095%'", 1), ([("id", "is null", None)], "id is null", 1), ([("v", ">", 1e9)], "v > 1e9", 10), ([("id", ">", 5000)], "id > 5000", 1), ([("k", ">", "k0850"), ("id", "<", 10)], "k > 'k0850' and id < 10", 1), ([("k", "is null", None)], "k is null", 10), ([("v", "is not null", None)], "true", 10)]
    for where, plain, files in cases:
        found = read_records(spark, path, where=where)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in rows.where(plain).collect()), plain
        assert opened(found) <= files + (files == 1), plain  # a range may end just there
    # several readers of one folder, and filters on top, don't touch each other
    few, more = (read_records(spark, path, where=[("id", op, v)]) for op, v in (("<", 100), (">=", 900)))
    assert few.union(more).count() == 200 and df.where("id < 100 or id > 900").count() == 199 and df.where("id < 5").union(df.where("id > 5")).count() == 999
    assert df.where("id < 100").alias("x").join(df.alias("y"), F.expr("x.id + 500 = y.id")).count() == 100 and df.count() == 1000
    part = read_records(spark, path, columns=["v", "id"])
    assert part.columns == ["v", "id"] and part.where("id = 7").first().id == 7
    part = read_records(spark, path, columns=["v"], where=[("id", "=", 7)])
    assert part.columns == ["v"] and part.count() == 1 and opened(part) <= 2


def test_commits_add_or_replace(spark, rows):
    path = scratch(spark, "rec")
    with pytest.raises(Exception, match="no records"):
        read_records(spark, path)
    write_records(rows.where("id < 10"), path)
    write_records(rows.where("id >= 10 and id < 30"), path, keys=["id"])
    assert read_records(spark, path).count() == 30 and len(commits(path)) == 2
    assert read_records(spark, path, where=[("id", "=", 25)]).count() == 1  # files without bounds are opened
    write_records(rows.where("false"), path)
    assert read_records(spark, path).count() == 30
    write_records(rows.where("id = 1"), path, replace=True)
    assert [r.id for r in read_records(spark, path).collect()] == [1]


def test_a_failed_write_is_not_seen(spark, rows):
    path = scratch(spark, "rec")
    write_records(rows.limit(5), path)
    with pytest.raises(Exception, match="stop here"):
        write_records(rows.withColumn("id", F.when(F.col("id") == 990, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")).cast("long")), path)
    assert read_records(spark, path).count() == 5 and len(commits(path)) == 1


@pytest.mark.parametrize("harm", ["flip", "cut", "head"])
def test_a_broken_record_raises(spark, rows, harm):
    path = scratch(spark, "rec")
    write_records(rows.coalesce(1), path)
    name = f"{path}/{commits(path)[0]['files'][0]['name']}"
    assert len(list(records(name))) >= 1
    system, at = _at(name)
    with system.open_input_stream(at) as f:
        data = bytearray(f.read())
    data = {"flip": data[:400] + bytes([data[400] ^ 1]) + data[401:], "cut": data[:-3], "head": data + b"\x01"}[harm]
    with system.open_output_stream(at) as f:
        f.write(bytes(data))
    with pytest.raises(PythonException, match="is broken"):
        read_records(spark, path).collect()


def test_long_rows_and_strings(spark):
    path = scratch(spark, "rec")
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, "y"), (3, None)], "id long, s string").coalesce(1)
    write_records(df, path, keys=["s"])
    assert "low" not in commits(path)[0]["files"][0]["keys"]["s"]
    assert {r.id: len(r.s or "") for r in read_records(spark, path).collect()} == {1: 3_000_000, 2: 1, 3: 0}
    assert read_records(spark, path, where=[("s", "=", "y")]).count() == 1


def test_bounds():
    some, none = {"nulls": False, "some": True, "low": 3, "high": 7}, {"nulls": True, "some": False}
    a = ("a",)
    for f, yes in [(ds.EqualTo(a, 3), True), (ds.EqualTo(a, 8), False), (ds.GreaterThan(a, 7), False), (ds.GreaterThanOrEqual(a, 7), True), (ds.LessThan(a, 3), False), (ds.LessThanOrEqual(a, 3), True), (ds.In(a, (1, 8)), False), (ds.In(a, (1, 5)), True), (ds.IsNull(a), False), (ds.IsNotNull(a), True), (ds.EqualNullSafe(a, None), False)]:
        assert may_match(some, f) == yes, f
        assert may_match(none, f) == isinstance(f, ds.IsNull) or f == ds.EqualNullSafe(a, None)
    assert may_match({"nulls": False, "some": True}, ds.EqualTo(a, 100)) and may_match(some, ds.Not(ds.EqualTo(a, 5)))


def test_a_stream_goes_on_where_it_stopped(spark, rows):
    """Two commits, a batch that fails half way, one more commit: each row comes once, in batches that a second run repeats exactly."""
    path, out, state = (scratch(spark, f"rec-{x}") for x in ("in", "out", "state"))
    write_records(rows.where("id < 100"), path)
    fail = []

    def write(batch, number):
        batch.select("id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if fail:
            raise ValueError("stopped in the middle")

    def run():
        query = stream_records(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    write_records(rows.where("id >= 100 and id < 300"), path)
    fail.append(True)
    with pytest.raises(Exception, match="stopped in the middle"):
        run()
    write_records(rows.where("id >= 300"), path)
    fail.clear()
    run()
    run()
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    assert {(r.batch, r["count"]) for r in got.groupBy("batch").count().collect()} == {(0, 100), (1, 200), (2, 700)}


def test_no_task_gets_more_than_its_share(spark, rows):
    # 600 long texts of one length, and 600 short ones: ranges of equal rows put all of the long ones into one task
    folder = scratch(spark, "even")
    spark.range(1200).selectExpr("id as doc_id", "repeat(char(97 + id % 26), if(id < 600, 6000, 10)) as text", "'en' as lang", "'web' as source", "if(id < 600, 6000L, 10 + id % 5) as n_chars").write.parquet(f"{folder}/documents.parquet")
    (got,) = catalogue.record_files(spark, folder).collect()
    assert (got.n, got.chars) == (600, 600 * 6000)
    made = [commits(f"{spark.conf.get('spark.checkpoint.dir')}/{p.name}")[0]["files"] for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("records-*")]
    (files,) = [x for x in made if sum(f["rows"] for f in x) == 1200]
    long = [f["rows"] for f in files if f["keys"]["n_chars"]["high"] == 6000]
    assert sum(long) == 600 and max(long) < 150, long
    assert all(f["keys"]["n_chars"]["low"] == 6000 for f in files if f["keys"]["n_chars"]["high"] == 6000)
    # nulls and nothing at all
    some = rows.withColumn("n", F.when(F.col("id") % 3 > 0, F.col("id")))
    assert in_ranges(some, "n", size=F.lit(8), tie="id").count() == 1000 and in_ranges(some.limit(0), "n", size=F.lit(8), tie="id").count() == 0
    for task_bytes in (100, 800, 10**9):
        sizes = [r["count"] * 8 for r in in_ranges(some, "n", size=F.lit(8), tie="id", least=1, task_bytes=task_bytes).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 8000 and max(sizes) <= 2 * task_bytes, sizes

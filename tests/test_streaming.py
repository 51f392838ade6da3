import time
from datetime import datetime, timedelta

from tessera.plans import catalogue
from tessera.sources.scratch import scratch
from tessera.streaming.events import events_stream, run_once, tumbling_counts, user_sessions
from tessera.streaming.stateful import first_of_each, followed_within, silent_users

SMALL, START = "/root/testdata/sf0.001", datetime(2024, 1, 1)


def written(spark, tag, *files):
    """A folder with an events table of one part file for each list of (hours, user)."""
    folder = scratch(spark, tag)
    for k, rows in enumerate(files):
        data = [(100 * k + j, START + timedelta(hours=h), user, "click", 1.0, "{}") for j, (h, user) in enumerate(rows)]
        df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def one_file_a_batch(spark, folder):
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet")
    return stream.withColumn("ts", stream["ts"].cast("timestamp"))


def test_a_row_behind_the_watermark_is_dropped(spark):
    # the third file's first row belongs to a day that the watermark had passed before the second, its second row doesn't
    folder = written(spark, "late", [(1, 1), (30, 1), (80, 1)], [(81, 1)], [(2, 1), (79.5, 1), (130, 1)], [(200, 1)])
    got = {(r.day, r.n) for r in run_once(tumbling_counts(one_file_a_batch(spark, folder)), "append", "t").collect()}
    assert got == {(START, 1), (START + timedelta(days=1), 1), (START + timedelta(days=3), 3), (START + timedelta(days=5), 1)}


def test_sessions_close_behind_the_watermark(spark):
    folder = written(spark, "sessions", [(1, 1), (1.4, 1), (1.2, 2)], [(1.5, 1), (9, 2)])
    got = sorted((r.user_id, r.session_start, r.n) for r in run_once(user_sessions(one_file_a_batch(spark, folder)), "append", "t").collect())
    assert got == [(1, START + timedelta(hours=1), 3), (2, START + timedelta(hours=1.2), 1)]


def test_a_table_of_part_files_streams(spark):
    folder = written(spark, "parts", [(1, 1), (2, 2)], [(3, 1)])
    assert run_once(events_stream(spark, folder).select("event_id"), "append", "t").count() == 3
    got = catalogue.stream_user_totals(spark, folder)
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 2), (2, 1)]


def batches(spark, tag, files, make):
    """The result of a stream over one file a batch."""
    return run_once(make(one_file_a_batch(spark, written(spark, tag, *files))), "append", "t").collect()


def test_silence_is_found_by_timers_however_rows_are_dealt(spark):
    files = [[(0, 1), (1, 1), (1, 1), (0.5, 2)], [(20, 1), (5, 2), (20.5, None)], [(19.5, 1), (30, 3)], [(26.2, 1), (60, 3)], [(61, 3)]]
    late = [(0, 1), (1, 1), (1, 1), (0.5, 2), (20, 1), (5, 2), (20.5, None), (19.5, 1), (30, 3), (26.2, 1), (60, 3), (61, 3)]
    want = {(1, 1.0, 3), (2, 5.0, 2), (1, 20.0, 2), (None, 20.5, 1), (1, 26.2, 1), (3, 30.0, 1)}  # user 3's last events may still go on
    for parts in (files, [late], [[x] for x in sorted(late, key=lambda x: x[0])]):
        got = batches(spark, "silent", parts, silent_users)
        assert {(r.user_id, round((r.last_seen - START).total_seconds() / 3600, 6), r.n) for r in got} == want and len(got) == len(want)


def test_a_late_event_takes_a_timer_back(spark):
    # the first file's last event would end a run, but the event at 6.5 hours comes, late, before the watermark has passed 7
    got = batches(spark, "late", [[(1, 1), (7.9, 2)], [(6.5, 1)], [(40, 2)], [(80, 2)]], silent_users)
    assert {(r.user_id, round((r.last_seen - START).total_seconds() / 3600, 6), r.n) for r in got} == {(1, 6.5, 2), (2, 7.9, 1), (2, 40.0, 1)}


def test_values_are_forgotten_when_they_expire(spark):
    folder = written(spark, "expiry", [(1, 1), (2, 1), (3, 2)], [(4, 1)])
    state, out = scratch(spark, "state"), []

    def run(stream):
        stream.writeStream.outputMode("append").foreachBatch(lambda b, _: out.append(sorted(map(tuple, b.collect()), key=str))).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()

    for wait in (0, 0, 5):  # one file each, the third run another row of the first's values
        if wait:
            time.sleep(wait)
            more = spark.createDataFrame([(500, START, 1, "click", 1.0, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
            more.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        run(first_of_each(one_file_a_batch(spark, folder), key="user_id", value="event_type", id_col="event_id", keep_ms=4000))
    assert out[0] == [(1, "click", 0), (2, "click", 2)] or out[0] == [(1, "click", 100)]
    assert (1, "click", 500) in out[-1]


def test_unmatched_rows_come_behind_the_watermark(spark):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    at = lambda h: START + timedelta(hours=h)
    folder = scratch(spark, "follow")
    files = [
        [(1, at(1), 1, "click"), (2, at(1), 2, "click"), (3, at(1.5), 1, "purchase"), (4, at(1), None, "click"), (5, at(2), None, "purchase")],
        [(6, at(2), 2, "purchase"), (7, at(1.7), 1, "purchase"), (8, at(30), 1, "click")],
        [(9, at(30.5), 3, "purchase"), (10, at(33), 9, "click"), (11, at(33), 9, "purchase")],
        [(12, at(33), 4, "click")],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    joined = followed_within(stream().where("event_type = 'click'"), stream().where("event_type = 'purchase'"), key="user_id", time="ts", id_col="event_id", out="purchase")
    got = sorted(map(tuple, run_once(joined, "append", "t").collect()), key=str)
    # 10 and 12 are within an hour of the watermark: a purchase might still follow
    assert got == sorted([(1, 3), (1, 7), (2, 6), (4, None), (8, None)], key=str)


def test_timers_do_not_grow_with_users(spark):
    # 4,000 users fall silent; a timer for each cost a round trip to Python each
    rows = spark.range(4000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' as ts", "id as user_id", "'click' as event_type", "1.0d as value", "'{}' as props")
    folder = scratch(spark, "many")
    rows.union(rows.limit(1).selectExpr("-1L", "ts + interval 1 day", "-1L", "event_type", "value", "props")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    query = silent_users(events_stream(spark, folder)).writeStream.format("memory").queryName("many").outputMode("append").option("checkpointLocation", scratch(spark, "many-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("many").count() == 4000 and spark.table("many").agg({"n": "max"}).first()[0] == 1
    timers = [s["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < sum(timers) < 2000, timers

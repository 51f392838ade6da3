"""The event stream: windows, deduplication and stateful totals with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.scratch import scratch
from tessera.sources.tables import table
from tessera.sources.workers import importable


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with ``ts`` as a timestamp so that it can carry a watermark.

    ``events.parquet`` may be one file or, as Spark writes large tables, a folder of part files.
    """
    schema, path = table(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        stream = spark.readStream.schema(schema).parquet(path)
    else:  # a stream reads folders: this one file of the folder that holds it
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str, tag: str, one_batch: bool = False) -> DataFrame:
    """Runs a stream over what there is and gives back its result; offsets, state and result are in the shared folder.

    ``one_batch`` is for state that expires by processing time: while there is such state, Spark always sees another batch to run.
    """
    spark = stream.sparkSession
    out = scratch(spark, f"{tag}-out")

    def write(batch: DataFrame, number: int) -> None:
        # complete mode gives all rows each time; a batch that runs again replaces its own folder
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, f"{tag}-state")).trigger(**({"once": True} if one_batch else {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width, every)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each user's sessions; in append mode a session is given once the watermark has passed its end."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n", "most")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; state goes when the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def user_totals(events: DataFrame) -> DataFrame:
    """Events and their largest value for each user, kept in arbitrary state: (user_id, n, most)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, most = state.get if state.exists else (0, float("-inf"))
        for batch in batches:
            n, most = n + len(batch), max(most, float(batch["value"].max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    importable(events.sparkSession)
    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, most double", "n long, most double", "update", GroupStateTimeout.NoTimeout)

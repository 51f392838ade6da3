"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources.scratch import scratch

from .common import col, materialise

#: Virtual slots. Fixed for the life of a data set: a record's slot never changes, only the map does.
SLOTS = 4096
#: A group of equal texts with more than 1/HOT of all bytes, an eighth of what one of eight shards holds, is spread over the slots by id.
#: Smaller groups stay whole: slots are dealt largest first, so what a group lacks to a full shard is made up by small slots.
HOT = 64


def assign(sizes: dict[int, int], shards: int) -> list[int]:
    """First map of slots to shards: largest slot first, each to the lightest shard."""
    load, out = [0] * shards, [0] * SLOTS
    for slot in sorted(range(SLOTS), key=lambda s: (-sizes.get(s, 0), s)):
        out[slot] = load.index(min(load))
        load[out[slot]] += sizes.get(slot, 0)
    return out


def grow(slot_map: Sequence[int], sizes: dict[int, int]) -> list[int]:
    """The map edited for one more shard: slots move into the new shard only.

    Each shard keeps its slots, largest first, up to its new share; the small ones behind move.
    """
    out, new, total = list(slot_map), max(slot_map) + 1, sum(sizes.values())
    kept = [0] * new
    for slot in sorted(range(SLOTS), key=lambda s: (-sizes.get(s, 0), s)):
        kept[slot_map[slot]] += sizes.get(slot, 0)
        if kept[slot_map[slot]] * (new + 1) > total:
            out[slot] = new
    return out


def save_map(spark: SparkSession, slot_map: Sequence[int], version: int, path: str) -> None:
    """Append a version of the map to the table at ``path``: (version, slot, shard)."""
    values = F.from_json(F.lit(json.dumps(list(slot_map))), "array<int>")
    rows = spark.range(1).select(F.lit(version).alias("version"), F.posexplode(values).alias("slot", "shard"))
    rows.coalesce(1).write.mode("append").parquet(path)


def newest(spark: SparkSession, path: str) -> int:
    """The newest version in the table of maps at ``path``; 0 if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return 0
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The map of ``version``, or the newest: SLOTS rows at most."""
    rows = spark.read.parquet(path).where(F.col("version") == (version or newest(spark, path)))
    return [r.shard for r in rows.orderBy("slot").collect()]


def _virtual(digest: Column) -> Column:
    """The slot of a hexadecimal digest: its first three digits."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def slotted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, seq): thin rows with each record's virtual slot, written down.

    Equal texts share a slot, except where one group has over 1/HOT of all bytes:
    such groups (fewer than HOT of them, so their broadcast is bounded) are dealt by id. ``seq`` tells equal rows apart.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    thin = docs.select(col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("h"))
    thin = materialise(thin.withColumn("seq", F.monotonically_increasing_id()), "shard-thin")
    total = thin.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = thin.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") * HOT > total) & (F.col("n") > 1))
    spread = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), "h"))
    marked = thin.join(F.broadcast(hot.select("h", F.lit(True).alias("hot"))), "h", "left")
    return materialise(marked.select("doc_id", "size", "text_crc32", _virtual(F.when(F.col("hot"), spread).otherwise(F.col("h"))).alias("vslot"), "seq"), "shard-slots")


def shard(docs: DataFrame, shards: int = 8, *, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot, next_shard, map_version): law ``bytes``.

    Records are hashed into SLOTS virtual slots, bytes are summed for each slot, and slots go
    to shards so that the shards' bytes are near equal. What the driver handles has SLOTS
    rows at any input size. ``next_shard`` is the record's shard if one more is added: its own, or the new one. ``slot`` is the
    record's place in its shard, gapless from 0, by virtual slot, then id (null first): rows are sorted in ranges, and a range's
    places follow from the counts of those before it, so no task sorts a shard or a slot.

    ``map_path`` is the table of map versions. Its newest version is used unchanged, so that a
    growing corpus keeps its placement until ``rebalance`` writes a new one; if it has none, a first map is made and stored as version 1.
    Without it the table is a new one in the shared folder.

    Null text has size 1 and the crc32 of the empty text. Null ids sort first. Repeated rows
    get places of their own. Very long texts are hashed as they stream through the task. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = slotted(docs, id_col=id_col, text_col=text_col)
    sizes = slot_sizes(rows)
    path = map_path or scratch(spark, "shard-map")
    if not newest(spark, path):
        save_map(spark, assign(sizes, shards), 1, path)
    version, slot_map = newest(spark, path), load_map(spark, path)
    of_slot = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<int>"), F.col("vslot"))
    order = ["shard", "vslot", "doc_id", "text_crc32", "size", "seq"]
    placed = rows.withColumn("shard", of_slot(slot_map)).withColumn("next_shard", of_slot(grow(slot_map, sizes)))
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "shard-sorted")
    runs = placed.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each range, and one more for each shard
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "part", (before - F.col("first")).alias("base"))
    out = placed.join(F.broadcast(runs), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("base")).alias("slot"), "vslot", "next_shard", F.lit(version).alias("map_version"))


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each virtual slot: SLOTS rows at most."""
    return {r.vslot: r.b for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}


def rebalance(spark: SparkSession, map_path: str, sizes: dict[int, int]) -> int:
    """Adds a shard: appends the newest map, edited by ``grow`` for ``slot_sizes``, as the next version, and returns that."""
    version = newest(spark, map_path) + 1
    save_map(spark, grow(load_map(spark, map_path), sizes), version, map_path)
    return version


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard", "map_version")


#: crc32 from its table; the greedy deal of slots and the edited map as recursions and windows.
OP7_SQL = """
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
thin AS (SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32, md5(text) AS h FROM hexed, tab),
grouped AS (SELECT *, sum(size) OVER (PARTITION BY h) * 64 > sum(size) OVER () AND count(*) OVER (PARTITION BY h) > 1 AS hot FROM thin),
slotted AS (SELECT *, CAST(('0x' || substr(CASE WHEN hot THEN md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || h) ELSE h END, 1, 3)) AS INTEGER) AS vslot FROM grouped),
sums AS (SELECT v AS vslot, coalesce(b, 0) AS b, row_number() OVER (ORDER BY coalesce(b, 0) DESC, v) AS k FROM range(4096) r(v) LEFT JOIN (SELECT vslot, CAST(sum(size) AS BIGINT) AS b FROM slotted GROUP BY vslot) ON v = vslot),
ordered AS (SELECT list(b ORDER BY k) AS bs FROM sums),
placed(k, loads, spot) AS (SELECT 0, list_transform(range(8), lambda x: 0::BIGINT), NULL::INTEGER
  UNION ALL SELECT k + 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + bs[k + 1] ELSE x END), CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM placed, ordered WHERE k < 4096),
map AS (SELECT vslot, spot AS shard, b FROM sums JOIN placed USING (k)),
grown AS (SELECT vslot, shard, CASE WHEN sum(b) OVER (PARTITION BY shard ORDER BY b DESC, vslot) * 9 <= sum(b) OVER () THEN shard ELSE 8 END AS next_shard FROM map)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, vslot, CAST(next_shard AS INTEGER) AS next_shard, 1 AS map_version
FROM slotted JOIN grown USING (vslot)
"""

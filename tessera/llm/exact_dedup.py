"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, hot_join, materialise, words_of_bits

#: Slots of the bit set that tells the last scan which rows survive; 2**22 bits are 65,536 rows to broadcast.
SLOTS = 1 << 22


def row_hashes(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text, null text as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(7), text, doc_id)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, slots: int = SLOTS, all_hashes: bool = False, row_keys: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    1. Rows are grouped by the text's byte length; lengths that occur once are done.
    2. The rest are grouped by length and the hash of the first ``prefix`` characters.
    3. Only rows of groups that are left have their full content hashed (SHA-256), and rows
       with equal length and full hash are copies. Each step knows the groups that the last one left from a bit
       set of ``slots`` bits, so its broadcast has a fixed size; a row that shares a slot by
       chance is looked at as well, which changes no result.

    Of copies the largest id stays. Groups only ever meet as counts and maxima that are
    combined before the shuffle, and large groups meet their rows by broadcast, so a group with a third of all
    rows is no hot spot.

    Null text counts as empty and empty texts are equal. Null ids are allowed: they never
    beat another id, and a group of null ids only keeps them all, as no id tells them apart.
    Rows that repeat an id and its text count in ``group_size`` and stand or fall together.
    Other columns are not read. An empty table gives an empty result. ``text_sha256`` is null
    for rows that needed no full hash, unless ``all_hashes`` asks for it. ``row_keys`` adds the columns k1 and k2, two hashes
    of id and text that tell rows apart where ids are null or repeat. A very long text is hashed as it streams through the task, like any other.
    """
    keys = ["k1", "k2"] if row_keys else []
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[k.alias(name) for name, k in zip(keys, row_hashes(F.col("doc_id"), F.col("text")), strict=False)], F.octet_length("text").alias("len"), F.xxhash64(F.substring("text", 1, prefix)).alias("pre"))

    thin = materialise(rows.select("len", "pre"), "exact-thin")
    lengths = thin.groupBy("len").count().where("count > 1")
    shared = _in_slots(thin, lengths, ["len"], slots).where("lives")
    prefixes = shared.groupBy("len", "pre").count().where("count > 1")
    marked, lives = _in_slots(rows, prefixes, ["len", "pre"], slots), F.col("lives")
    full = F.sha2("text", 256)
    hashed = materialise(marked.select("doc_id", *keys, "len", lives, (full if all_hashes else F.when(lives, full)).alias("sha")), "exact-full")

    alive = hashed.where("lives")
    groups = alive.groupBy("len", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    shared = hot_join(alive, groups, ["len", "sha"], "group_size", alive.count()).select("doc_id", *keys, "keep_id", "group_size", "sha")
    alone = hashed.where("not lives").select("doc_id", *keys, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return shared.union(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), *keys)


def _in_slots(rows: DataFrame, groups: DataFrame, by: list[str], slots: int) -> DataFrame:
    """``rows`` with ``lives``: whether the slot of their columns ``by`` is that of one of ``groups``. At most slots / 64 rows are broadcast, none shuffled."""
    slot = F.pmod(F.xxhash64(*by), F.lit(slots))
    used = words_of_bits(groups.select(slot.alias("slot")), "slot")
    marked = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(used), "word", "left")
    lives = F.expr("coalesce(mask, 0L) & shiftleft(1L, cast(slot & 63 as int))") != 0
    return marked.withColumn("lives", lives).drop("slot", "word", "mask")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), all_hashes=True)


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

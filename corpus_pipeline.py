"""Documents to packed training sequences: five stages, each one operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import clear, fresh, materialise, scratch_scope, settle
from tessera.llm.exact_dedup import exact_dedup, row_hashes
from tessera.llm.language_id import held_out, identify, train
from tessera.llm.near_dedup import near_dedup, text_hash
from tessera.llm.packing import pack
from tessera.llm.pii import mask


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the calibrated classifier rejects: no letters, or no language it knows with enough certainty.

    Null and empty texts have no letters and go. Null ids and repeated rows are judged by their text like any other; very
    long texts in full. An empty table stays empty. Extra columns stay, whatever their names.
    """
    name = fresh(docs, "lang_id")
    labelled = identify(docs, train(docs.where(~held_out())), out_col=name)
    return labelled.where(~F.col(f"{name}.rejected")).drop(name)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of equal texts stays: that with the largest id, null ids last.

    Null text counts as empty. Decisions are on rows, by hashes of id and text, so ids may be null or repeat: a unique text
    stays though its id also has a copy, and rows that repeat an id and its text leave one. Very long texts are compared in
    full. An empty table stays empty. Extra columns stay, whatever their names.
    """
    judged = exact_dedup(docs, row_keys=True).where("group_size > 1")
    decided = judged.groupBy("k1", "k2").agg(F.min("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    k1, k2 = row_hashes(docs["doc_id"], docs["text"])
    return settle(docs, materialise(decided, "exact-decided"), k1, k2, docs["doc_id"])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each class of near copies stays.

    Rows enter by a 64-bit hash of their text instead of an id, so ids may be null or repeat; the text of the smallest hash stands
    for its class, and of rows of equal text the one with the smallest id stays, null ids last. Texts
    without words (null and empty ones too) are no copies of other texts, but equal ones leave one. Very long texts are compared in full. An empty table
    stays empty. Extra columns stay, whatever their names.
    """
    key = F.xxhash64(F.lit(3), F.coalesce(docs["text"], F.lit("")))
    judged = near_dedup(docs.select(key.alias("doc_id"), docs["text"].alias("text")), with_hash=True)
    decided = judged.groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2")).agg(F.min("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    return settle(docs, materialise(decided, "near-decided"), key, text_hash(docs["text"]), F.struct(docs["doc_id"].isNull(), docs["doc_id"]))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text, and n_chars follows; a null text stays null, with its n_chars.

    Every row is masked by its own text, whatever its id. Very long texts are masked in full. An empty table
    stays empty. Extra columns stay, whatever their names.
    """
    out = mask(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Null and empty texts are one piece of one id each; null ids and repeated rows are packed each; long texts are cut, not
    shortened. An empty table gives no pieces. Extra columns are not read.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL expresses a trained classifier, signatures or bin completion; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written to the shared folder and reread."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch_scope() as paths:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, before + paths[:-1])  # the stage's own tables and the last one's result
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

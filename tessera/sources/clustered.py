"""Parquet files in Morton order of two columns, with a manifest that lets readers skip files.

A folder holds ``data-*`` folders and ``manifest-*`` tables, one for each version. A manifest has a row for each file with the least and largest values of
the columns; it is written under another name and renamed when it is complete, which is the commit: until
then, and if a write fails, readers see the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.workers import importable

#: Bits of each column's place in the order; so many quantiles are taken.
BITS = 8


def morton(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bits of ``x`` and ``y`` in turn, the highest of ``x`` first."""
    out = np.zeros(len(x), np.int64)
    for bit in range(bits):
        out |= ((x >> bit) & 1) << (2 * bit + 1) | ((y >> bit) & 1) << (2 * bit)
    return out


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x.removeprefix("manifest-")) for x in names if x.startswith("manifest-"))


def _number(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    return F.unix_micros(F.col(column).cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else F.col(column)


def write_clustered(df: DataFrame, path: str, *, by: tuple[str, str], files: int) -> int:
    """Writes ``df`` as the next version in ``files`` files, near in both columns of ``by`` (numbers or times) within each; gives the version.

    Quantiles put both columns on one scale, whatever their distribution; nulls and NaN come first. Rows are dealt in ranges of the order and of a hash, so that a value
    with a third of all rows is no single file.
    """
    spark = df.sparkSession
    importable(spark)
    x, y, z = "_place_x", "_place_y", "_place"
    rows = df.withColumns({n: F.when(F.isnan(v.cast("double")), None).otherwise(v.cast("double")) for n, v in zip((x, y), (_number(df, c) for c in by), strict=True)})
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    cuts = [np.array(c) for c in rows.approxQuantile([x, y], shares, 1 / (1 << BITS + 2))]

    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(morton(*[np.where(v.isna(), 0, np.searchsorted(c, v.to_numpy(), "left")) for c, v in zip(cuts, (a, b), strict=True)]))

    data = f"{path}/data-{uuid.uuid4().hex}"
    spread = F.xxhash64(x, y, *[c for c in df.columns[:4]])
    placed = rows.withColumn(z, place(x, y)).withColumn(x, spread)
    placed.repartitionByRange(files, z, x).sortWithinPartitions(z).select(*df.columns).write.parquet(data)
    written = spark.read.schema(df.schema).parquet(data).select(*by, F.col("_metadata.file_path").alias("file"))
    facts = [f(F.col(c)).alias(f"{n}_{k}") for k, c in enumerate(by) for n, f in (("low", F.min), ("high", F.max), ("some", F.count))]
    fs, p = _fs(spark, f"{path}/_writing-{uuid.uuid4().hex}")
    manifest = written.groupBy("file").agg(F.count("*").alias("rows"), *facts).withColumn("columns", F.array(*[F.lit(c) for c in by]))
    manifest.coalesce(1 + files // 50_000).write.parquet(str(p.toString()))
    number = max(versions(spark, path), default=-1) + 1
    _, target = _fs(spark, f"{path}/manifest-{number:08d}")
    if fs.exists(target) or not fs.rename(p, target):  # another writer was faster: its version stands
        raise FileExistsError(str(target.toString()))
    return number


def files_for(spark: SparkSession, path: str, where: Sequence[tuple[str, object, object]], version: int | None = None) -> list[str]:
    """The files that may hold rows that meet all ``where``, each (column, least value, largest value), both included, none for no bound. The manifest is filtered by Spark; only names that are wanted come to the driver."""
    number = versions(spark, path)[-1] if version is None else version
    manifest = spark.read.parquet(f"{path}/manifest-{number:08d}")
    columns = (manifest.select("columns").first() or [[]])[0]
    for column, low, high in where:
        if column in columns:
            k = columns.index(column)
            # NaN is the largest of all numbers, so it only widens a file's range
            manifest = manifest.where((F.col(f"some_{k}") > 0) & (F.lit(True) if low is None else F.col(f"high_{k}") >= F.lit(low)) & (F.lit(True) if high is None else F.col(f"low_{k}") <= F.lit(high)))
    return [r["file"] for r in manifest.select("file").collect()]


def read_clustered(spark: SparkSession, path: str, schema: T.StructType, *, where: Sequence[tuple[str, object, object]] = (), version: int | None = None) -> DataFrame:
    """The rows of the last version (or of ``version``) that meet all ``where``; other files are not opened."""
    found = files_for(spark, path, where, version)
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    for column, low, high in where:
        rows = rows.where(F.col(column).between(low, high) if None not in (low, high) else F.col(column) >= low if low is not None else F.col(column) <= high if high is not None else F.col(column).isNotNull())
    return rows

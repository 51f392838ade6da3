"""Reading and writing the common file formats with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Options that make a format give back what was written. CSV fields with line breaks would need ``multiLine``, which makes a file one task's; keep such texts in another format.
OPTIONS = {"csv": {"header": "true", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}, "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}}
FORMATS = ("parquet", "orc", "json", "csv")


def save(df: DataFrame, path: str, kind: str = "parquet", *, partition_by: list[str] | None = None) -> None:
    if kind not in FORMATS:
        raise ValueError(kind)
    writer = df.write.format(kind).options(**OPTIONS.get(kind, {}))
    if kind == "csv":
        writer = writer.option("emptyValue", '""')  # quoted, apart from null
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def load(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """The schema is given, never inferred: inference reads the data twice."""
    if kind not in FORMATS:
        raise ValueError(kind)
    return spark.read.format(kind).options(**OPTIONS.get(kind, {})).schema(schema).load(path)

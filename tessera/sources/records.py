"""Record files as a data source in Python: checked records, skipping by conditions, replayable streams.

A folder holds data files and, in ``_commits``, one JSON file for each write, which lists its data files with the least and largest
value of the key columns. A data file is a run of records: length and CRC-32 of the payload (four bytes each,
little-endian), then the payload, a batch of rows in Arrow's stream format. What no commit lists doesn't exist for a reader.

Conditions reach the reader as an option of its own load, not by ``pushFilters``: PySpark 4.1.2 keeps one read plan for all
queries over a loaded source, so the filters that one query pushes are applied to the others too (a union of two filtered reads lost half of
its rows here).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.workers import importable

NAME = "tessera_records"
#: Bytes of rows in a record, and of records in a data file, about.
RECORD_BYTES, FILE_BYTES = 1 << 20, 128 << 20
#: Longer strings are no bounds: a file whose least or largest key is longer can't be skipped by it.
KEY_CHARS = 256
HEAD = struct.Struct("<II")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _bounds(column: pa.ChunkedArray | pa.Array) -> dict:
    """Least and largest value and whether there are nulls; no bounds for kinds that JSON doesn't keep exactly, for NaN and for long strings."""
    out = {"nulls": column.null_count > 0, "some": column.null_count < len(column)}
    if not (pa.types.is_integer(column.type) or pa.types.is_string(column.type) or pa.types.is_floating(column.type)) or not out["some"]:
        return out
    low, high = (x.as_py() for x in pc.min_max(column).values())
    nan = pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py()
    return out if nan or any(isinstance(x, str) and len(x) > KEY_CHARS for x in (low, high)) else out | {"low": low, "high": high}


def _joined(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    out = {"nulls": a["nulls"] or b["nulls"], "some": a["some"] or b["some"]}
    bounded = [x for x in (a, b) if x["some"]]
    if bounded and all("low" in x for x in bounded):
        out |= {"low": min(x["low"] for x in bounded), "high": max(x["high"] for x in bounded)}
    return out


def may_match(bounds: dict, f: ds.Filter) -> bool:
    """Whether a file with these bounds of the filter's column may hold a row that passes."""
    if isinstance(f, ds.IsNull) or (isinstance(f, ds.EqualNullSafe) and f.value is None):
        return bounds["nulls"]
    if not bounds["some"]:
        return not isinstance(f, ds.EqualTo | ds.EqualNullSafe | ds.GreaterThan | ds.GreaterThanOrEqual | ds.LessThan | ds.LessThanOrEqual | ds.In | ds.StringStartsWith | ds.IsNotNull)
    if "low" not in bounds:
        return True
    low, high = bounds["low"], bounds["high"]
    match f:
        case ds.EqualTo() | ds.EqualNullSafe():
            return f.value is not None and low <= f.value <= high
        case ds.GreaterThan():
            return high > f.value
        case ds.GreaterThanOrEqual():
            return high >= f.value
        case ds.LessThan():
            return low < f.value
        case ds.LessThanOrEqual():
            return low <= f.value
        case ds.In():
            return any(v is not None and low <= v <= high for v in f.value)
        case ds.StringStartsWith():
            return low[: len(f.value)] <= f.value <= high[: len(f.value)]
    return True


def commits(path: str) -> list[dict]:
    """The commits that count, oldest first: those from the last one that replaces what was there."""
    system, root = _at(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    out: list[dict] = []
    for info in sorted((x for x in found if x.base_name.endswith(".json")), key=lambda x: x.base_name):
        with system.open_input_stream(info.path) as f:
            commit = json.loads(f.read())
        out = [commit] if commit["replaces"] else [*out, commit]
    return out


def records(path: str) -> Iterator[bytes]:
    """The payloads of a data file; raises for a record that is cut short or doesn't have its checksum."""
    system, at = _at(path)
    with system.open_input_stream(at) as f:
        n = 0
        while head := f.read(HEAD.size):
            length, check = HEAD.unpack(head) if len(head) == HEAD.size else (0, None)
            payload = f.read(length)
            if check is None or len(payload) != length or zlib.crc32(payload) != check:
                raise ValueError(f"record {n} of {path} is broken")
            yield payload
            n += 1


def _batches(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for payload in records(path):
        with pa.ipc.open_stream(payload) as first:
            wanted = [first.schema.get_field_index(c) for c in names]
        options = pa.ipc.IpcReadOptions(included_fields=wanted)  # other columns are not decoded
        with pa.ipc.open_stream(payload, options=options) as f:
            yield from (b.select(names) for b in f)


@dataclass
class DataFile(ds.InputPartition):
    path: str


#: Conditions that a reader understands: the filter that bounds are held against, and the column expression that rows are.
CONDITIONS = {
    "=": (ds.EqualTo, lambda c, v: c == v),
    "<": (ds.LessThan, lambda c, v: c < v),
    "<=": (ds.LessThanOrEqual, lambda c, v: c <= v),
    ">": (ds.GreaterThan, lambda c, v: c > v),
    ">=": (ds.GreaterThanOrEqual, lambda c, v: c >= v),
    "in": (ds.In, lambda c, v: c.isin(list(v))),
    "starts with": (ds.StringStartsWith, lambda c, v: c.startswith(v)),
    "is null": (lambda a, _: ds.IsNull(a), lambda c, _: c.isNull()),
    "is not null": (lambda a, _: ds.IsNotNull(a), lambda c, _: c.isNotNull()),
}
Where = Sequence[tuple[str, str, object]]


class RecordReader(ds.DataSourceReader):
    """One task for each data file that may hold rows that meet all conditions."""

    def __init__(self, path: str, schema: StructType, where: Where) -> None:
        self.path, self.names = path, schema.names
        self.filters = [CONDITIONS[op][0]((column,), value) for column, op, value in where]

    def partitions(self) -> Sequence[DataFile]:
        wanted = [x for commit in commits(self.path) for x in commit["files"]]
        for f in self.filters:
            wanted = [x for x in wanted if f.attribute[0] not in x["keys"] or may_match(x["keys"][f.attribute[0]], f)]
        return [DataFile(f"{self.path}/{x['name']}") for x in wanted] or [DataFile("")]

    def read(self, partition: DataFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(partition.path, self.names)


class RecordStream(ds.DataSourceStreamReader):
    """The data files in the order of their commits; the offset is how many of them have gone by.

    Files never change, and commits are only added, so a range of offsets always gives the same rows. A
    commit that replaces others ends a stream that has begun before it.
    """

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def _files(self) -> list[str]:
        found = commits(self.path)
        if any(c["replaces"] for c in found) and found[0]["number"] > 0:
            raise ValueError(f"{self.path} has been replaced")
        return [x["name"] for c in found for x in c["files"]]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> Sequence[DataFile]:
        return [DataFile(f"{self.path}/{x}") for x in self._files()[start["files"] : end["files"]]]

    def read(self, partition: DataFile) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.path, self.names)

    def commit(self, end: dict) -> None:
        """Nothing to free: files stay for other readers, and Spark's own checkpoint knows how far this one is."""


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class RecordWriter(ds.DataSourceArrowWriter):
    """Each task writes data files of its own under new names; the commit lists those of the tasks that count."""

    def __init__(self, path: str, schema: StructType, keys: list[str], replaces: bool) -> None:
        self.path, self.schema, self.keys, self.replaces = path, schema.json(), keys, replaces

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _at(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                step = max(1, RECORD_BYTES * batch.num_rows // max(batch.nbytes, 1))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    if out is None or size > FILE_BYTES:
                        if out:
                            out.close()
                        files.append({"name": f"{uuid.uuid4().hex}.rec", "rows": 0, "keys": dict.fromkeys(self.keys)})
                        out, size = system.open_output_stream(f"{root}/{files[-1]['name']}"), 0
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    payload = sink.getvalue().to_pybytes()
                    out.write(HEAD.pack(len(payload), zlib.crc32(payload)))
                    out.write(payload)
                    size += len(payload)
                    files[-1]["rows"] += part.num_rows
                    files[-1]["keys"] = {k: _joined(files[-1]["keys"][k], _bounds(part.column(k))) for k in self.keys}
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """One writer at a time: of two that commit at once the later one fails, and nothing of it is seen."""
        system, root = _at(self.path)
        system.create_dir(f"{root}/_commits", recursive=True)
        taken = [int(x.base_name.split(".")[0]) for x in system.get_file_info(fs.FileSelector(f"{root}/_commits")) if x.base_name.endswith(".json")]
        number = max(taken, default=-1) + 1
        body = {"number": number, "replaces": self.replaces, "schema": self.schema, "files": [x for m in messages if m for x in m.files]}
        target, temporary = f"{root}/_commits/{number:08d}.json", f"{root}/_commits/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps(body).encode())
        if system.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(target)
        system.move(temporary, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        for x in (x for m in messages if m for x in m.files):
            if system.get_file_info(f"{root}/{x['name']}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/{x['name']}")


class RecordFiles(ds.DataSource):
    """Options: path; keys, the columns whose bounds a write keeps; columns, those that a reader wants (others are not decoded); where, its conditions. Lists are in JSON."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _list(self, option: str) -> list[str]:
        return json.loads(self.options.get(option, "[]"))

    def schema(self) -> StructType:
        found = commits(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no records at {self.options['path']}")
        schema = StructType.fromJson(json.loads(found[-1]["schema"]))
        return StructType([schema[c] for c in self._list("columns") or schema.names])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], schema, self._list("where"))

    def streamReader(self, schema: StructType) -> RecordStream:
        return RecordStream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema, self._list("keys"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    importable(spark)
    spark.dataSource.register(RecordFiles)


def in_ranges(df: DataFrame, by: str, *, size: Column, tie: str, least: int = 16, task_bytes: int = 32 << 20, bins: int = 256) -> DataFrame:
    """``df`` dealt in ranges of the number ``by`` of about ``task_bytes`` each, by ``size``, the bytes of a row; or in about ``least`` smaller ones. So no task's share grows with ``df``.

    The bytes between ``bins`` quantiles decide: small bins of neighbouring values share a range, and one that holds more is dealt over several by a hash of ``tie``,
    so that neither long rows nor one frequent value meet in a task. Nulls are with the smallest.
    """
    importable(df.sparkSession)
    cuts = np.unique(df.select(F.col(by).cast("double").alias("v")).approxQuantile("v", [k / bins for k in range(1, bins)], 1 / (4 * bins)))

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), 0, np.searchsorted(cuts, v.to_numpy(np.float64, na_value=0), "left")))

    held = {r["at"]: r["b"] or 0 for r in df.groupBy(place(F.col(by).cast("double")).alias("at")).agg(F.sum(size).alias("b")).collect()}
    most = max(1, min(task_bytes, sum(held.values()) // least))
    first, parts, n, room = [], [], 0, 0
    for at in range(len(cuts) + 1):
        b = held.get(at, 0)
        if b > room:
            first, n, room = [*first, n], n + max(1, -(-b // most)), most - b
        else:
            first, room = [*first, max(n - 1, 0)], room - b
        parts.append(max(1, -(-b // most)))
    at = place(F.col(by).cast("double")) + 1
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), at)
    return df.repartitionById(max(n, 1), (of(first) + F.pmod(F.xxhash64(tie), of(parts))).cast("int"))


def write_records(df: DataFrame, path: str, *, keys: Sequence[str] = (), replace: bool = False) -> None:
    """Adds the rows of ``df`` to the record files at ``path``, or replaces them, in one commit. For files that can be skipped, ``df`` should be dealt in ranges of ``keys``."""
    register(df.sparkSession)
    df.write.format(NAME).mode("overwrite" if replace else "append").option("keys", json.dumps(list(keys))).save(path)


def read_records(spark: SparkSession, path: str, *, columns: Sequence[str] = (), where: Where = ()) -> DataFrame:
    """The rows of all commits that meet all conditions of ``where``, each (column, operator of CONDITIONS, number, string or list of them).

    Files whose bounds rule a condition out are not opened; rows of the others are filtered as usual.
    """
    register(spark)
    read = list(dict.fromkeys([*columns, *(c for c, *_ in where)])) if columns else []
    rows = spark.read.format(NAME).option("columns", json.dumps(read)).option("where", json.dumps([list(w) for w in where])).load(path)
    for column, op, value in where:
        rows = rows.where(CONDITIONS[op][1](F.col(column), value))
    return rows.select(*columns) if columns else rows


def stream_records(spark: SparkSession, path: str, *, columns: Sequence[str] = ()) -> DataFrame:
    """The same as a stream: each batch has what has been committed since the last."""
    register(spark)
    return spark.readStream.format(NAME).option("columns", json.dumps(list(columns))).load(path)

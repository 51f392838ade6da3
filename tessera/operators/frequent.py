"""Exact heavy hitters by candidates of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import write_down
from tessera.sources.workers import importable


def reduced(keys: pa.Array, counts: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, int]:
    """(keys, counts, taken off): of more than ``most`` keys, all counts less the largest that has to go, and the keys that then have any."""
    if len(counts) <= most:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1])
    left = counts > off
    return keys.filter(pa.array(left)), counts[left] - off, off


def heavy_hitters(df: DataFrame, key: str, share: float, out: str = "n") -> DataFrame:
    """(key, n): each value of ``key`` that at least ``share`` of all rows have, with its exact count; nulls are a value.

    Each task keeps Misra-Gries counters for 2 / share keys at most, so its memory doesn't depend on the number of keys; merged, their counts are too small by half of the share at
    most, so that no key is lost and 2 / share are left as candidates, whose rows are then counted exactly. Between tasks go only the counters.
    """
    if not 0 < share <= 1:
        raise ValueError(share)
    importable(df.sparkSession)
    most = int(np.ceil(2 / share))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = None, np.zeros(0, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            new = batch.column(0).value_counts()
            values, n = new.field("values"), new.field("counts").to_numpy()
            if keys is not None:
                merged = pa.concat_arrays([keys, values.cast(keys.type)]).dictionary_encode("encode")
                counts = np.bincount(merged.indices.to_numpy(), np.concatenate([counts, n]), len(merged.dictionary)).astype(np.int64)
                keys = merged.dictionary
            else:
                keys, counts = values, n
            keys, counts, _ = reduced(keys, counts, most)
        if rows:
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts), pa.array([rows, *[0] * (len(counts) - 1)] if len(counts) else [], pa.int64())], names=["k", "n", "rows"])

    counters = write_down(df.select(key).mapInArrow(run, f"k {kind.simpleString()}, n long, rows long"), "counters")
    total = df.count()
    candidates = counters.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > total * share / 2 - 1).select("k")
    found = df.select(F.col(key).alias("c")).join(F.broadcast(candidates), F.col("c").eqNullSafe(F.col("k")))  # 2 / share rows
    return found.groupBy(F.col("c").alias(key)).agg(F.count("*").alias(out)).where(F.col(out) >= total * share)

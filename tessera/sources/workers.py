"""What Python workers need."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Puts this package's place on the workers' path, for drivers that have found it in another way than by PYTHONPATH."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def give_back() -> None:
    """Returns to the system what this process has freed. A worker waits for its next task with it otherwise, beside an executor's JVM that has grown meanwhile."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def frugal[T](run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """``run`` over a task's batches, with ``give_back`` at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[T]) -> Iterator[T]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped

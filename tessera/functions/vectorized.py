"""Functions in Arrow batches, for what built-in functions can't express well."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


@F.pandas_udf(T.LongType())
def digit_sum(numbers: pd.Series) -> pd.Series:
    """The sum of the decimal digits of each whole number."""
    rest, out = numbers.abs().to_numpy(np.int64), np.zeros(len(numbers), np.int64)
    while rest.any():
        out += rest % 10
        rest = rest // 10
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def spread(values: pd.Series) -> float:
    """Largest less smallest value of a group: a grouped aggregate in Arrow batches. A group is one task's; for unbounded groups take built-in aggregates."""
    return float(values.max() - values.min())


@F.udtf(returnType="place: int, digit: int")
class Digits:
    """A table function: one row for each decimal digit of a whole number, from the left."""

    def eval(self, number: int):
        if number is not None:
            for place, digit in enumerate(str(abs(number))):
                yield place, int(digit)


#: Groups whose states a task holds before it hands them on.
MOST_GROUPS = 10_000


def two_phase(df: DataFrame, by: Sequence[str], columns: Sequence[str], *, partial: Callable[..., np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], Sequence], schema: str, most_groups: int = MOST_GROUPS) -> DataFrame:
    """A user-defined aggregate whose groups no task ever holds: (``by``, the columns of ``schema``).

    ``partial`` makes a state, an array of numbers, from the arrays of ``columns`` of some rows of a group, ``merge`` one state of two, ``finish`` the result of a state. Tasks reduce their rows
    batch by batch to one state a group (those of ``most_groups`` groups at a time, and a batch's); only states are shuffled, so a group has as many as there are tasks. Nulls reach ``partial`` as NaN.
    Null keys are a group.
    """
    by, columns, held = list(by), list(columns), "_state"
    while held.lower() in {c.lower() for c in by}:
        held = f"_{held}"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, np.ndarray] = {}
        kinds = None

        def out() -> pa.RecordBatch:
            keys = [pa.array(list(c), t) for c, t in zip(zip(*states, strict=True), kinds, strict=True)]
            batch = pa.RecordBatch.from_arrays([*keys, pa.array([x.tolist() for x in states.values()], pa.list_(pa.float64()))], names=[*by, held])
            states.clear()
            return batch

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            code = np.zeros(batch.num_rows, np.int64)
            for c in by:
                part = batch.column(c).dictionary_encode("encode")
                code = np.unique(code * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            values = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[order] for c in columns]
            keys = zip(*[batch.column(c).take(pa.array(order[starts])).to_pylist() for c in by], strict=True)
            for key, a, b in zip(keys, starts, np.append(starts[1:], len(order)), strict=True):
                new = partial(*[v[a:b] for v in values])
                states[key] = merge(states[key], new) if key in states else new
            if len(states) > most_groups:
                yield out()
        if states:
            yield out()

    def finished(table: pa.Table) -> pa.Table:
        states = iter(np.array(x) for x in table.column(held).to_pylist())
        state = next(states)
        for x in states:
            state = merge(state, x)
        return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in by], *[pa.array([v], t) for v, t in zip(finish(state), kinds.values(), strict=True)]], names=[*by, *kinds])

    kinds = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema).fields}
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    states = df.select(*by, *columns).mapInArrow(reduce, f"{keys}, {held} array<double>")
    return states.groupBy(*by).applyInArrow(finished, f"{keys}, {schema}")


def least_squares(df: DataFrame, by: Sequence[str], y: str, x: Sequence[str], most_groups: int = MOST_GROUPS) -> DataFrame:
    """(``by``, n, intercept, a column for each of ``x``): linear regression of ``y`` on several columns within each group, by two-phase moments.

    Moments are kept about their means and merged as such, so large values lose no digits. Rows with a null or NaN are left out; what can't be told from the rows (fewer than columns, or
    dependent ones) gets the least coefficients that fit; a group without rows has nulls.
    """
    m = len(x) + 1

    def partial(*values: np.ndarray) -> np.ndarray:
        rows = np.stack(values)
        rows = rows[:, ~np.isnan(rows).any(axis=0)]
        mean = rows.mean(axis=1) if rows.shape[1] else np.zeros(m)
        off = rows - mean[:, None]
        return np.concatenate([[rows.shape[1]], mean, (off @ off.T).ravel()])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1 : m + 1] - a[1 : m + 1]
        return np.concatenate([[n], a[1 : m + 1] + gap * b[0] / n, a[m + 1 :] + b[m + 1 :] + (np.outer(gap, gap) * a[0] * b[0] / n).ravel()])

    def finish(state: np.ndarray) -> list:
        n, mean, cross = int(state[0]), state[1 : m + 1], state[m + 1 :].reshape(m, m)
        if not n:
            return [0, *[None] * m]
        slopes = np.linalg.lstsq(cross[1:, 1:], cross[1:, 0], rcond=1e-12)[0]
        return [n, float(mean[0] - slopes @ mean[1:]), *map(float, slopes)]

    return two_phase(df, by, [y, *x], partial=partial, merge=merge, finish=finish, schema=", ".join(["n long", "intercept double", *[f"`{c}` double" for c in x]]), most_groups=most_groups)


@F.udtf
class FillGaps:
    """Adds the days that are missing between a partition's rows: ``FillGaps(table, day column, values column)`` over a TABLE argument with PARTITION BY and ORDER BY the day.

    Its columns are those of the table and ``filled``: added rows repeat the other columns of the row before, with 0 in the values column. It holds one row at a time. Rows with a null day pass as
    they are.
    """

    @staticmethod
    def analyze(table, day, value):
        from pyspark.sql.udtf import AnalyzeResult

        if not table.isTable:
            raise ValueError("the first argument is a TABLE")
        names = table.dataType.names
        if missing := {day.value, value.value} - set(names):
            raise ValueError(f"the table has no {sorted(missing)}")
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("filled", T.BooleanType())]))

    def __init__(self):
        self.before = None

    def eval(self, row, day: str, value: str):
        from datetime import timedelta

        now = row.asDict()
        if self.before is not None and now[day] is not None:
            for k in range(1, (now[day] - self.before[day]).days):
                yield (*(self.before | {day: self.before[day] + timedelta(days=k), value: 0}).values(), True)
        if now[day] is not None:
            self.before = now
        yield (*now.values(), False)

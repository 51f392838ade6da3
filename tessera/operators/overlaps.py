"""Joins of spans with spans."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import write_down
from tessera.sources.workers import frugal, importable

#: Rows of one side that a bin should hold at most, and copies of the other side's rows at most, when a bin is split.
BIN_ROWS, MOST_SALTS = 1_000_000, 1024
#: Spans that a part of the keys should hold at most; parts at least, to keep all cores busy, if each then holds so many spans.
PART_ROWS, LEAST_PARTS, WORTH_ROWS = 2_000_000, 6, 50_000
#: Spans that are packed together, that are looked up at once, places of a table of marks, pairs that are sorted instead, pairs that are made at once.
PACK_ROWS, LOOKUPS, MARKS, SORTED, AT_ONCE = 1_000_000, 200_000, 1 << 25, 1 << 21, 1 << 15


def _level(low: Column, high: Column) -> Column:
    """The least k with high - low <= 2**k."""
    length = high - low
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _shift(number: Column, by: Column) -> Column:
    return F.call_function("shiftright", number, by.cast("int"))


def overlap_join(left: DataFrame, right: DataFrame, *, left_span: tuple[str, str], right_span: tuple[str, str], on: Column | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows whose half-open spans [low, high), whole numbers, overlap (and that fulfil ``on``), each pair once.

    A span of a length up to 2**k touches two bins of that width at most. Two spans meet in the bins of the longer one's width: the longer side is
    listed there only, the shorter one in its bins of each width that the other side has, so a row is listed some dozen times at most, however
    different the lengths are. Of two common bins, the one in which the overlap begins counts. Where spans are so long that a bin would hold most rows of
    the other side, these are dealt over several tasks and the few long spans copied to each. Spans that are null, empty or backwards match nothing. The two sides' columns must differ in their names.
    """
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError(f"both sides have {sorted(clash)}")
    if taken := {c for c in [*left.columns, *right.columns] if c.startswith("_bin_")}:
        raise ValueError(f"names kept for this join: {sorted(taken)}")
    sides = []
    for df, (low, high), tag in ((left, left_span, "l"), (right, right_span, "r")):
        a, b = F.col(low).cast("long"), F.col(high).cast("long")
        sides.append(df.where(a < b).withColumns({f"_bin_{tag}a": a, f"_bin_{tag}b": b}).withColumn(f"_bin_{tag}k", _level(F.col(f"_bin_{tag}a"), F.col(f"_bin_{tag}b"))))
    known = [{r["k"]: r for r in df.groupBy(F.col(f"_bin_{t}k").alias("k")).agg(F.count("*").alias("n"), F.min(f"_bin_{t}a").alias("low"), F.max(f"_bin_{t}b").alias("high")).collect()} for df, t in zip(sides, "lr", strict=True)]  # 64 rows at most
    rows = [sum(r["n"] for r in x.values()) for x in known]
    ends = [r for x in known for r in x.values()]
    width = max((r["high"] for r in ends), default=1) - min((r["low"] for r in ends), default=0)
    # the longer side first; with equal widths the left one counts as the longer
    parts = [_meet(sides[0], "l", known[0], sides[1], "r", rows[1], width, bin_rows, equal=True), _meet(sides[1], "r", known[1], sides[0], "l", rows[0], width, bin_rows, equal=False)]
    out = [p.where(on) if on is not None else p for p in parts]
    names = [*left.columns, *right.columns]
    return out[0].select(*names).union(out[1].select(*names))


def _meet(longer: DataFrame, x: str, levels: dict, shorter: DataFrame, y: str, others: int, width: int, bin_rows: int, *, equal: bool) -> DataFrame:
    """Pairs whose longer span (or equally wide, if ``equal``) is of ``longer``."""
    salts = {k: max(1, min(MOST_SALTS, -(-others * min(1 << k, width) // (max(width, 1) * bin_rows)))) for k in levels}
    many = F.element_at(F.create_map(*[F.lit(v) for k, n in (salts or {0: 1}).items() for v in (k, n)]), F.col("_bin_k"))
    bins = lambda t: F.explode(F.sequence(_shift(F.col(f"_bin_{t}a"), F.col("_bin_k")), _shift(F.col(f"_bin_{t}b") - 1, F.col("_bin_k"))))
    a = longer.withColumn("_bin_k", F.col(f"_bin_{x}k")).withColumn("_bin_at", bins(x)).withColumn("_bin_salt", F.explode(F.sequence(F.lit(0), many - 1)))
    wanted = F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>")
    above = F.filter(wanted, lambda k: (k >= F.col(f"_bin_{y}k")) if equal else (k > F.col(f"_bin_{y}k")))
    b = shorter.withColumn("_bin_k", F.explode(above)).withColumn("_bin_at", bins(y)).withColumn("_bin_salt", F.pmod(F.xxhash64(f"_bin_{y}a", f"_bin_{y}b", *shorter.columns[:8]), many).cast("int"))
    begins = F.greatest(F.col(f"_bin_{x}a"), F.col(f"_bin_{y}a"))
    inside = (F.col(f"_bin_{x}a") < F.col(f"_bin_{y}b")) & (F.col(f"_bin_{y}a") < F.col(f"_bin_{x}b"))
    # listed once for each width, a side is far larger than Spark's estimate of it, so none may be broadcast
    return a.join(b.hint("merge"), ["_bin_k", "_bin_at", "_bin_salt"]).where(inside & (_shift(begins, F.col("_bin_k")) == F.col("_bin_at")))


def overlap_totals(spans: DataFrame, *, key: str, span: tuple[str, str], part_rows: int | None = None) -> DataFrame:
    """(key, pairs, partners, together) for each key with a span that overlaps one of another key: how many pairs of its spans with other keys' there
    are, with how many different keys, and the sum of the lengths of their overlaps. Spans are half-open [low, high); key and ends are whole numbers.

    No pair leaves its task. Keys are dealt to parts by hash, each part's spans are packed, and each two parts meet in a task of their own, so each two keys
    meet in one task and numbers of different partners can be added. What goes to disk is each packed span a few times, however many parts there are: the product of parts
    and parts reads it again and again instead. A task holds the spans of two parts. It finds pairs and lengths from sorted ends alone; for different partners it goes
    over the pairs and marks them in tables of bounded size, so only its time grows with the pairs. A key's spans are in one part, however many they are.
    Spans that are empty, backwards or null, and null keys, match nothing. ``spans`` is read twice.
    """
    importable(spans.sparkSession)
    low, high = span
    fine = spans.select(F.col(key).cast("long").alias("key"), F.col(low).cast("long").alias("a"), F.col(high).cast("long").alias("b")).where("key is not null and a < b")
    n, rows = fine.count(), part_rows or PART_ROWS
    parts = max(1, -(-n // rows), min(LEAST_PARTS, n // WORTH_ROWS))

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(4))
        order = np.lexsort((a, part))
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            at = order[ends[p] : ends[p + 1]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(keys[at], a[at], b[at])], pa.binary())], names=["part", "spans"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PACK_ROWS:
                yield from pack(held)
                held = []
        if held:
            yield from pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, one, two in (row for k in range(batch.num_rows) for row in zip(*(c.slice(k, 1).to_pylist() for c in batch.columns), strict=True)):
                for found in _meetings(*map(_unpacked, [one] if p == q else [one, two])):
                    yield from pa.table(dict(zip(("key", "pairs", "partners", "together"), found, strict=True))).to_batches(max_chunksize=100_000)

    dealt = fine.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "a", "b").mapInArrow(frugal(packs), "part int, spans binary")
    packed = write_down(dealt.groupBy("part").agg(F.collect_list("spans").alias("spans")), "packed-spans")
    side = lambda t: packed.select(F.col("part").alias(f"part{t}"), F.col("spans").alias(f"spans{t}")).repartitionById(parts, f"part{t}")
    both = side(1).join(side(2).hint("shuffle_replicate_nl"), F.col("part1") <= F.col("part2")).select("part1", "part2", "spans1", "spans2")  # one row a part
    found = both.mapInArrow(frugal(meet), "key long, pairs long, partners long, together long")
    return found.groupBy(F.col("key").alias(key)).agg(*[F.sum(c).alias(c) for c in ("pairs", "partners", "together")])


def _packed(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Spans in order of their starts: few bytes each, as starts are given by their distances and most lengths are alike."""
    batch = pa.record_batch([keys, np.diff(a, prepend=0), b - a], names=["key", "step", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, each span's place among them, starts, ends), in order of starts."""
    tables = [pa.ipc.open_stream(blob).read_all() for blob in blobs]
    a = np.concatenate([np.cumsum(t.column("step").to_numpy()) for t in tables])
    keys, lengths = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("key", "length"))
    order = np.argsort(a, kind="stable")
    code, names = pd.factorize(keys[order])
    a = a[order]
    return names, code, a, a + lengths[order]


def _meetings(x: tuple, y: tuple | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, pairs, partners, together) for the keys of each of two parts that meet a key of the other; of one part alone, for those that meet another in it."""
    names, code, a, b = x
    if y is None:
        times = np.unique(np.concatenate([a, b]))
        place = lambda t: code * len(times) + np.searchsorted(times, t)  # noqa: E731 the key first: what a key shares with itself
        (pairs, together), (own_pairs, own_together) = _crossed(code, a, b, a, b), _crossed(code, a, b, a, b, places=(place(a), place(b)))
        sides = [(names, pairs - own_pairs, _partners(code, a, b, code, a, b, pairs, alone=True)[0], together - own_together)]
    else:
        names2, code2, a2, b2 = y
        (pairs, together), (pairs2, together2) = _crossed(code, a, b, a2, b2), _crossed(code2, a2, b2, a, b)
        partners, partners2 = _partners(code, a, b, code2, a2, b2, pairs, alone=False)
        sides = [(names, pairs, partners, together), (names2, pairs2, partners2, together2)]
    for side in sides:
        met = side[1] > 0
        yield tuple(c[met] for c in side)


def _crossed(code: np.ndarray, a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how many of the other spans its own overlap, and for how long in all: a span meets those that begin before its end, less those that end before it begins.

    The time that all others have run until t is t times (begun - ended), less their starts, plus their ends. These sums may wrap around; their difference is right.
    ``places`` order the spans, which are then both sides, by something else than their times.
    """
    at_start, at_end = places or (a, b)
    sa, sb = places or (starts, ends)
    by_start, by_end = np.argsort(sa, kind="stable"), np.argsort(sb, kind="stable")
    sums = [np.append(0, np.cumsum(t[at])) for t, at in ((starts, by_start), (ends, by_end))]
    sa, sb = sa[by_start], sb[by_end]
    pairs, together = np.zeros((2, int(code.max()) + 1), np.int64)
    for k in range(0, len(a), LOOKUPS):
        at = slice(k, k + LOOKUPS)
        (begun, ended), (begun2, ended2) = ((np.searchsorted(sa, t[at], "left"), np.searchsorted(sb, t[at], "right")) for t in (at_start, at_end))
        before, after = (t[at] * (i - j) - sums[0][i] + sums[1][j] for t, i, j in ((a, begun, ended), (b, begun2, ended2)))
        np.add.at(pairs, code[at], begun2 - ended)
        np.add.at(together, code[at], after - before)
    return pairs, together


def _partners(x: np.ndarray, xa: np.ndarray, xb: np.ndarray, y: np.ndarray, ya: np.ndarray, yb: np.ndarray, pairs: np.ndarray, *, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many different keys of the other side each key meets; both sides in order of starts. ``pairs``: of each key of x. ``alone``: they are the same spans, and a key doesn't meet itself.

    Keys of x are taken in blocks. Of two spans that meet, one begins within the other, so pairs are ranges of either side in order of starts, each pair in
    one range. Keys that meet are marked in a table of a block's keys and all of y, or the pairs are sorted where they would fill too little of it.
    """
    nx, ny = len(pairs), int(y.max()) + 1
    spans, upto = np.cumsum(np.bincount(x, minlength=nx)), np.cumsum(pairs)
    long = np.flatnonzero(yb - ya > 1)  # nothing begins later within the others
    la, lb, ly = ya[long], yb[long], y[long]
    dense = nx * ny * (1 + len(long) / LOOKUPS) <= 256 * int(upto[-1])  # a sorted pair takes as long as some 256 places; each table has a look at all that is long
    many = pairs > SORTED
    limits = (np.arange(nx) // max(1, MARKS // ny) if dense else (upto - pairs) // SORTED + 2 * np.cumsum(many) - many, (spans - 1) // LOOKUPS)
    block = np.cumsum(np.any([np.diff(k, prepend=k[0]) != 0 for k in limits], axis=0))
    order, firsts = np.argsort(block[x], kind="stable"), np.flatnonzero(np.diff(block, prepend=-1))
    of_x, of_y, spans = np.zeros(nx, np.int64), np.zeros(ny, np.int64), np.append(0, spans)
    for first, end in zip(firsts, np.append(firsts, nx)[1:], strict=True):
        at = order[spans[first] : spans[end]]
        starts, row = xa[at], (x[at] - first) * ny
        within_x = _ranges(row, y, np.searchsorted(ya, starts), np.searchsorted(ya, xb[at]))
        within_y = _ranges(ly, row, np.searchsorted(starts, la, "right"), np.searchsorted(starts, lb))
        if dense or end - first == 1:
            seen = np.zeros((end - first, ny), bool)
            for place in chain(within_x, within_y):
                seen.reshape(-1)[place] = True
            if alone:
                seen[np.arange(end - first), np.arange(first, end)] = False
            of_x[first:end] += np.fromiter(map(np.count_nonzero, seen), np.int64, end - first)
            for k in range(0, end - first, 255):  # so many fit into a byte
                of_y += seen[k : k + 255].view(np.uint8).sum(axis=0, dtype=np.uint8)
        else:
            met = np.unique(np.concatenate([np.zeros(0, np.int64), *within_x, *within_y]))
            i, j = met // ny + first, met % ny
            other = i != j if alone else slice(None)
            np.add.at(of_x, i[other], 1)
            np.add.at(of_y, j[other], 1)
    return of_x, of_y


def _ranges(own: np.ndarray, other: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[np.ndarray]:
    """``own`` of each range plus each of ``other`` from ``lo`` to ``hi``, some at a time."""
    some = np.flatnonzero(lo < hi)
    own, lo, n = own[some], lo[some], (hi - lo)[some]
    upto = np.cumsum(n)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, int(n.sum()), AT_ONCE)))
    for i, j in zip(cuts, np.append(cuts, len(n))[1:], strict=True):
        many = n[i:j]
        at = np.arange(int(many.sum()))
        at += np.repeat(lo[i:j] - upto[i:j] + many + (upto[i] - many[0]), many)
        found = np.repeat(own[i:j], many)
        found += other[at]
        yield found

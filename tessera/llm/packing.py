"""Best-fit packing of token sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import functools
import itertools
import logging
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources.workers import frugal

from .common import col, materialise, small_batches

#: Tokens in a sequence and the id after each document.
CAPACITY, END = 1024, 2
#: The one string that the vocabulary treats as special, and texts so long that only the reference tokenizer encodes them.
SPECIAL, LONG = "<|endoftext|>", 1 << 20
#: Steps that backtracking has besides the two greedy dives: at least, and for each length that occurs.
NODES, NODES_EACH = 1000, 1
#: Fillings that a step compares, items in an enumerated filling, tokens that it may leave over.
FILLINGS, ITEMS, WASTE = 6, 3, 48
#: Bins that the last stage takes apart at a time, its steps for each such try, and tries.
TAIL, TAIL_STEPS, TRIES = 16, 20_000, 12

log = logging.getLogger(__name__)


def _vocabulary(folder: str | None):
    if folder is None:
        import public_tokenizers as vocab
    else:
        import importlib.util
        import os

        spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
        vocab = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(vocab)
    return vocab


@functools.cache
def _fast(folder: str | None):
    """The vocabulary as ranks for the faster encoder, whose ids are those of the Tokenizers file."""
    import base64

    import tiktoken

    vocab = _vocabulary(folder)
    with open(vocab.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _exact(folder: str | None):
    """The Tokenizers file. Few texts need it, so a worker that meets none doesn't hold it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_vocabulary(folder).path("byte_bpe_50k.json"))


def encode(text: str, folder: str | None = None) -> np.ndarray:
    """The ids that the Tokenizers file gives without added special tokens.

    Ordinary texts go through the same ranks in tiktoken, five times as fast; texts
    that name the special token, are very long or hold very long runs of spaces take the Tokenizers file itself.
    """
    if SPECIAL not in text and len(text) <= LONG:
        try:
            return np.asarray(_fast(folder).encode_to_numpy(text, disallowed_special=()), "<u4")
        except ValueError:  # its expression gives up on very long runs of spaces
            pass
    return np.array(_exact(folder).encode(text, add_special_tokens=False).ids, "<u4")


def pieces_of(length: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): the first piece takes what full pieces leave over."""
    first = length % capacity or capacity
    yield 0, 0, first
    for k, start in enumerate(range(first, length, capacity), 1):
        yield k, start, capacity


def _cut(capacity: int, folder: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text, folder), np.array([END], "<u4"))
                for piece, start, n in pieces_of(len(ids), capacity):
                    out.append((doc_id, piece, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, seen[n]))
                    seen[n] += 1
            got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            yield got.astype({"doc_id": "Int64"})

    return run


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: for each k, pieces over capacity - k are alone with what is under k, and pieces of k to half a sequence must fit beside the larger ones."""
    n = np.concatenate([counts, np.zeros(max(0, capacity + 1 - len(counts)), counts.dtype)])[: capacity + 1].astype(np.int64)
    pieces, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    large = pieces[capacity] - pieces[half]  # over half a sequence: one each
    middle, middle_tokens = pieces[capacity - k] - pieces[half], tokens[capacity - k] - tokens[half]
    small = tokens[half] - np.where(k > 0, tokens[k - 1], 0)
    return int((large + np.maximum(0, -(-(small - (middle * capacity - middle_tokens)) // capacity))).max())


def best_fit(counts: np.ndarray, room: int) -> list[int]:
    """The largest sizes that fit, one after the other."""
    left, out = counts.copy(), []
    while room > 0 and len(at := np.flatnonzero(left[1 : room + 1])):
        size = int(at[-1]) + 1
        take = int(min(left[size], room // size))
        out += [size] * take
        left[size] -= take
        room -= take * size
    return out


def fillings(counts: np.ndarray, room: int, waste: int) -> list[list[int]]:
    """Undominated fillings of ``room`` of up to ITEMS sizes with at most ``waste`` left over, fullest first, and the best fit.

    A filling is dominated if another has an item at least as large for each of its items; so
    of equally full ones those with fewer, larger items come first.
    """
    found: list[list[int]] = [best_fit(counts, room)]
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0]
    for total in range(room, max(0, room - waste) - 1, -1):
        if len(found) > FILLINGS:
            break
        if total and counts[total]:
            found.append([total])
            break  # it dominates whatever is less full
        a = sizes[sizes < total]
        b = total - a
        fits = (b <= a) & (counts[b] > (a == b))
        found += [[int(x), int(total - x)] for x in a[fits][::-1][:FILLINGS]]
        if not fits.any() and ITEMS > 2:
            most = sizes[sizes < total][::-1][:64, None]
            c = total - most - sizes
            ok = (sizes <= most) & (c > 0) & (c <= sizes)
            ok &= counts[np.where(ok, c, 0)] > 0
            for k in np.flatnonzero(ok.any(axis=1)):
                x = most[k, 0]
                trio = [[int(x), int(y), int(total - x - y)] for y in sizes[ok[k]][::-1][:2]]
                found += [t for t in trio if all(counts[s] >= t.count(s) for s in t)][:1]
                if len(found) > FILLINGS:
                    break
    unique = {tuple(sorted(f, reverse=True)) for f in found}
    kept = [f for f in unique if not any(g != f and len(g) >= len(f) and all(x <= y for x, y in zip(f, g, strict=False)) for g in unique)]
    return [list(f) for f in sorted(kept, key=lambda f: (-sum(f), len(f), [-x for x in f]))[:FILLINGS]]


def maximal(sizes: list[int], left: list[int], room: int, spend: Callable[[], bool] = lambda: True) -> Iterator[tuple[int, ...]]:
    """Each filling of ``room`` that no further piece fits into, as counts of ``sizes`` (descending), those with larger pieces first; as long as ``spend`` allows steps."""
    taken = [0] * len(sizes)

    def go(k: int, room: int, least: int) -> Iterator[tuple[int, ...]]:
        """``least``: the smallest size of which a piece was left out; the filling is maximal if that doesn't fit."""
        if not spend():
            return
        while k < len(sizes) and (not left[k] or sizes[k] > room):
            least = min(least, sizes[k]) if left[k] else least
            taken[k] = 0
            k += 1
        if k == len(sizes):
            if room < least:
                yield tuple(taken)
            return
        most = min(left[k], room // sizes[k])
        for n in range(most, -1, -1):
            taken[k] = n
            yield from go(k + 1, room - n * sizes[k], min(least, sizes[k]) if n < left[k] else least)
        taken[k] = 0

    yield from go(0, room, room + 1)


def repack(counts: np.ndarray, most: int, capacity: int, steps: int) -> tuple[list[list[int]] | None, bool]:
    """(bins, whole): at most ``most`` bins that hold ``counts``, if any were found; whether the search went through all cases.

    Bin completion one bin at a time: the largest piece with each maximal filling around it; fillings that another one dominates
    piece by piece are passed over, nodes are cut by ``lower_bound``, and no set of pieces is tried twice. Fillings are made as they are needed, and the
    search ends after ``steps`` steps, of making fillings included.
    """
    sizes = [int(s) for s in np.flatnonzero(counts)[::-1]]
    tried: dict[tuple[int, ...], int] = {}
    used = 0

    def spend() -> bool:
        nonlocal used
        used += 1
        return used <= steps

    def bound(left: tuple[int, ...]) -> int:
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = left
        return lower_bound(full, capacity)

    def go(left: tuple[int, ...], bins: int) -> list[list[int]] | None:
        first = next((k for k, n in enumerate(left) if n), None)
        if first is None:
            return []
        if bins <= tried.get(left, 0) or not spend() or bound(left) > bins:
            return None
        tried[left] = bins  # no packing of what is left into so many, unless one is found now
        room, rest = capacity - sizes[first], [n - (k == first) for k, n in enumerate(left)]
        made, kept = maximal(sizes, rest, room, spend), []
        while some := list(itertools.islice(made, 64)):
            for filling in sorted(some, key=lambda f: -sum(n * s for n, s in zip(f, sizes, strict=True))):
                items = [s for s, n in zip(sizes, filling, strict=True) for _ in range(n)]
                if any(len(g) >= len(items) and all(x <= y for x, y in zip(items, g, strict=False)) for g in kept[:64]):
                    continue  # dominated
                kept.append(items)
                found = go(tuple(a - b for a, b in zip(rest, filling, strict=True)), bins - 1)
                if found is not None or used > steps:
                    return None if found is None else [[sizes[first], *items], *found]
        return None

    found = go(tuple(int(counts[s]) for s in sizes), most)
    return found, used <= steps


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (sizes, times) that pack ``counts`` pieces of each size, found by bin completion; logs how far ``search`` came.

    What ``search`` finds is improved bin by bin: the TAIL bins with most room left over, in which a saving must be found if there is one in few bins, are
    taken apart and packed into one bin less by ``repack``, which also takes a filling fewer times than it goes. All bins are
    taken apart if there are no more than TAIL, so small inputs get an optimum, proved if the steps suffice; of larger ones TRIES sets of bins, the fullest of the last set being exchanged for others.
    """
    patterns, report = search(counts, capacity)
    bound, tries, proved = report["bins"] - report["gap"], 0, False
    rng = np.random.default_rng(6)
    while report["bins"] > bound and tries < TRIES and not proved:
        room = np.array([capacity - sum(items) for items, _ in patterns])
        order = np.argsort(-(room + (rng.random(len(room)) * capacity / 8 if tries else 0)), kind="stable")
        chosen, bins, small = Counter(), 0, np.zeros(capacity + 1, np.int64)
        for k in order:
            n = min(TAIL - bins, patterns[k][1])
            if n > 0:
                chosen[int(k)], bins = n, bins + n
                np.add.at(small, patterns[k][0], n)
        tries += 1
        if sum(room[k] * n for k, n in chosen.items()) < capacity:
            continue
        found, whole = repack(small, bins - 1, capacity, TAIL_STEPS)
        if found is not None:
            patterns = [(items, n - chosen[k]) for k, (items, n) in enumerate(patterns) if n > chosen[k]] + [(items, 1) for items in found]
            report["bins"], report["gap"], tries = report["bins"] - 1, report["gap"] - 1, 0
        proved = found is None and whole and bins == report["bins"]
    report |= {"tries": tries, "proved": int(proved or report["bins"] == bound)}
    told = log.warning if not report["proved"] else log.info
    told("packing: %(bins)d sequences, %(gap)d over the lower bound (greedy dives: %(greedy)d sequences); %(branches)d branches searched in %(steps)d steps, %(open)d left; %(tries)d sets of bins taken apart since the last gain; proved least: %(proved)d", report)
    return patterns


def search(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], dict[str, int]]:
    """(patterns, report) of the branch-and-bound.

    Each step takes the largest size left, fills around it with an undominated filling and
    repeats that as often as the counts allow, so that the work depends on the number of
    different sizes, not of pieces. Depth first; the first dive, always with the fullest
    filling, and a plain best fit are the first incumbents. A branch is cut if its waste so far
    leaves it no better than the incumbent. The search ends at the lower bound, when no branch is left, or when backtracking has
    taken NODES steps or NODES_EACH for each size that occurs, whichever is more; the dives don't count, and a branch begun is followed to its end.
    No branch is dropped from the stack, which only holds siblings of the current path. A step does not branch over
    more than FILLINGS fillings, enumerated ones of over ITEMS items or over WASTE left over, nor over fewer repeats of one, so an
    empty stack proves the optimum among these only.

    ``report``: bins, greedy (bins after the dives), gap (to the lower bound), branches (searched after the dives),
    steps (of them), open (branches on the stack at the end).
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    bound, total = lower_bound(counts, capacity), int((counts * np.arange(len(counts))).sum())
    budget = max(NODES, NODES_EACH * int((counts > 0).sum()))
    best, best_bins, nodes = None, np.inf, 0
    stack: list[tuple] = []

    def apply(left, path, chosen, size, bins, waste):
        items = [size, *chosen]
        n = max(1, int(min(left[s] // items.count(s) for s in set(items))))
        left = left.copy()
        for s in items:
            left[s] -= n
        return left, (items, n, path), bins + n, waste + n * (capacity - sum(items))

    def dive(left: np.ndarray, path: tuple | None, bins: int, waste: int, plain: bool) -> None:
        """One descent from here; alternatives go to the stack."""
        nonlocal best, best_bins, nodes
        while len(at := np.flatnonzero(left)):
            allowed = np.inf if best_bins == np.inf else (best_bins - 1) * capacity - total
            if waste > allowed:
                return
            nodes += 1
            size = int(at[-1])
            left[size] -= 1
            options = [best_fit(left, capacity - size)] if plain else fillings(left, capacity - size, WASTE)
            left[size] += 1
            stack.extend((left, path, other, size, bins, waste) for other in options[:0:-1])
            left, path, bins, waste = apply(left, path, options[0], size, bins, waste)
        if bins < best_bins:
            best, best_bins = path, bins

    dive(counts, None, 0, 0, True)
    dive(counts, None, 0, 0, False)
    greedy, nodes, branches = best_bins, 0, 0
    while stack and nodes < budget and best_bins > bound:
        left, path, chosen, size, bins, waste = stack.pop()
        if waste > (best_bins - 1) * capacity - total:
            continue
        branches += 1
        dive(*apply(left, path, chosen, size, bins, waste), False)
    patterns = []
    while best:
        items, n, best = best
        patterns.append((items, n))
    return patterns[::-1], {"bins": int(best_bins), "greedy": int(greedy), "gap": int(best_bins) - bound, "branches": branches, "steps": nodes, "open": len(stack)}


def intervals(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Where the pieces of each length go by their rank: rows (length, first, last, bin, each, at).

    Ranks first to last of a length fill bins from ``bin`` on, ``each`` to a bin, one behind the other from offset ``at``.
    """
    rows, used, bins = [], {}, 0
    for items, n in patterns:
        at = 0
        for size in sorted(set(items), reverse=True):
            each = items.count(size)
            first = used.get(size, 0)
            rows.append((size, first, first + n * each - 1, bins, each, at))
            used[size] = first + n * each
            at += size * each
        bins += n
    return pd.DataFrame(rows, columns=["length", "first", "last", "bin", "each", "at"], dtype=np.int64)


def by_range(places: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(places with a column ``range``, rows (length, width)): a rank meets only the places of its range, rank // width.

    A length's ranks are cut into as many ranges as it has places, so places get at most twice as many rows, and a
    range holds two places on average.
    """
    widths = places.groupby("length").agg(n=("first", "size"), last=("last", "max")).reset_index()
    widths["width"] = (widths["last"] + widths["n"]) // widths["n"]
    placed = places.merge(widths[["length", "width"]], on="length")
    placed["range"] = [range(a, b + 1) for a, b in zip(placed["first"] // placed["width"], placed["last"] // placed["width"], strict=True)]
    placed = placed.drop(columns="width").explode("range")
    return placed.astype(np.int64), widths[["length", "width"]].astype(np.int64)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each document.

    A document is its ids and END; only longer ones than ``capacity`` are cut. The texts are
    read once; what follows moves thin rows. Only the histogram of lengths (``capacity`` counts)
    reaches the driver, and what it broadcasts is bounded by the number of patterns. Pieces are ranked within their
    length by partition and place in it, so a length that most pieces have is no hot group.

    Null text counts as empty (one piece of one id), null ids are kept, repeated rows are
    packed each, other columns are not read, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    cut = rows.mapInPandas(frugal(_cut(capacity, folder)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    with small_batches(spark):
        cut = materialise(cut, "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    places = intervals(complete_bins(counts, capacity))
    places, widths = by_range(places)
    # as Arrow tables: rows of Python objects would go through Python workers of another kind, which stay beside the others
    places = spark.createDataFrame(pa.Table.from_pandas(places, preserve_index=False), "length long, first long, last long, bin long, each long, at long, range long")
    widths = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(widths, preserve_index=False), "length long, width long"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("part", "length", before.alias("before")).join(widths, "length")
    ranked = cut.join(by_part, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).withColumn("range", F.expr("rank div width"))
    out = ranked.join(F.broadcast(places), ["length", "range"]).where("rank between first and last")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("bin + (rank - first) div each").alias("sequence_id"), F.expr("at + pmod(rank - first, each) * length").alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

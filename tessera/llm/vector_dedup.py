"""Embedding near-dedup: random projections decoded to E8 lattice points in several tables, cosine verified."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, components, hot_join, materialise, small_batches
from .text import BASE, mixed

#: Least cosine of a link; tables; lattice blocks of 8 projections in a table; scale of the lattice against the root mean square length of a unit vector's block.
SIMILAR, TABLES, BLOCKS, SCALE = 0.98, 8, 3, 0.7
#: Vectors of a cell that one task compares with as many others.
BLOCK = 256
#: Rows of cells that one call of Python gets, about.
CALL = 4000


@functools.cache
def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to a point's neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers with an even sum) to each row."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point to each row: D8, or D8 shifted by a half in all places."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(axis=1, keepdims=True) <= ((x - b) ** 2).sum(axis=1, keepdims=True), a, b)


@functools.cache
def _projection(dim: int, tables: int, blocks: int) -> np.ndarray:
    """Gaussian directions (tables, blocks, dim, 8), scaled so that a unit vector's block has the length of its share."""
    rng = np.random.default_rng([7, dim, tables, blocks])
    return rng.normal(0, 1 / np.sqrt(max(dim, 8)), (tables, blocks, dim, 8))


def cells(vectors: np.ndarray, group: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE) -> np.ndarray:
    """(n, tables x 2**blocks) cell keys, ascending: in each table the own cell and those next to it.

    In each block a vector probes its lattice point and the neighbour that its projection is
    nearest to; a table's cells are all combinations. The table's number is in the key's top
    bits, ``group`` (what may be compared at all) in its hash. Repeated keys are -1.
    """
    out = []
    for t, table in enumerate(_projection(vectors.shape[1], tables, blocks)):
        choices = []
        for directions in table:
            x = vectors @ directions / (scale * np.sqrt(8 / max(vectors.shape[1], 8)))
            own = decode(x)
            step = _shortest()[((x - own) @ _shortest().T).argmax(axis=1)]
            codes = [np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)]
            for k, point in enumerate((own, own + step)):
                for column in (point * 2).astype(np.int64).T:
                    codes[k] = mixed(codes[k] * np.uint64(BASE) + column.astype(np.uint64))
            choices.append(codes)
        for combination in itertools.product(*choices):
            key = mixed(group.astype(np.uint64) + np.uint64(t))
            for code in combination:
                key = mixed(key * np.uint64(BASE) + code)
            out.append((np.uint64(t) << np.uint64(56)) | (key >> np.uint64(8)))
    keys = np.sort(np.stack(out, axis=1).astype(np.int64), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, some in batch.groupby(batch["embedding"].map(len)):
            x = np.stack(some["embedding"].to_list()).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # far from overflow
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            group = mixed(some["label"].to_numpy(np.int64).view(np.uint64) * np.uint64(BASE) + np.uint64(dim))
            keys = cells(x, group)
            yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy(), "copies": some["copies"].to_numpy(), "unit": list(x), "cells": [k[k >= 0] for k in keys]})


def _links(cell: int, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, cells: list[np.ndarray], apart: np.ndarray | None, similar: float) -> tuple | None:
    """(ids, links, roots) of one cell's linked vectors: a link is counted if no smaller cell holds the pair, connected in any case.

    ``apart`` numbers the blocks where only vectors of different blocks are to be compared.
    """
    linked = x @ x.T >= similar
    if apart is not None:
        linked &= apart[:, None] != apart[None, :]
    np.fill_diagonal(linked, False)
    some = linked.any(axis=1)
    if not some.any():
        return None
    linked, ids, copies, before = linked[np.ix_(some, some)], ids[some], copies[some], [c[c < cell] for c, y in zip(cells, some, strict=True) if y]
    own = np.repeat(np.arange(len(ids)), [len(k) for k in before])
    keys, at, n = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    use = n[at] > 1
    shared = np.zeros((len(ids), len(keys)), np.float32)
    shared[own[use], at[use]] = 1
    shared = shared[:, n > 1]
    links = (linked & ~(shared @ shared.T > 0)) @ copies
    root, was = ids.copy(), None
    while was is None or (root != was).any():
        was = root
        root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
    return ids, links, root


def _compare(similar: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of some cells, or pairs of blocks of large ones, one after the other; some thousand rows in all."""
        order = np.lexsort((rows["j"], rows["i"], rows["cell"]))
        x, ids, copies, cells = np.stack(rows["unit"].to_list()), rows["vec_id"].to_numpy(), rows["copies"].to_numpy(), rows["cells"].to_numpy()
        cell, i, j, block = (rows[c].to_numpy()[order] for c in ("cell", "i", "j", "block"))
        new = np.flatnonzero((cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip([0, *new], [*new, len(cell)], strict=True):
            at = order[a:b]
            got = _links(cell[a], x[at], ids[at], copies[at], list(cells[at]), block[a:b] if i[a] != j[a] else None, similar)
            if got is not None:
                out.append(got)
        return pd.DataFrame(dict(zip(("vec_id", "links", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def vector_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors of equal label and length link at a cosine of ``similar`` (double precision).
    Equal vectors are copies: one of them stands for all, weighted by their number. In TABLES tables, random
    projections are decoded to points of the E8 lattice; vectors that share a cell, each probing
    its own and the nearest neighbouring ones, are compared in full. A pair is counted in the
    smallest cell that holds it, so counts add up without a list of pairs, and each cell gives a
    spanning forest of its links. A large cell is cut into blocks of about BLOCK vectors and each two blocks are one
    task, so no group meets in one place. Cells that hold the same vectors are one; small ones share a call of Python.

    Vectors that are null, empty, zero, or hold null or non-finite components, null labels and
    null ids link with nothing: n_links 0, component_id the own id, kept. Rows that repeat an id and
    its vector count as copies; an id with several vectors is one node for all of them. Other columns are not read. An empty table gives an empty result.
    """
    with small_batches(vectors.sparkSession):
        return _vector_dedup(vectors, id_col, vector_col, label_col, similar)


def _vector_dedup(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, similar: float) -> DataFrame:
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("embedding"), col(label_col).alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    same = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(11), "embedding", "label").alias("h2")]
    rows = materialise(rows.select("vec_id", "embedding", F.xxhash64("label").alias("label"), "fine", *same), "vec-rows")
    ids = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    reps = rows.where("fine").join(ids, ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"]).select("vec_id", "label", "embedding", "copies")
    coded = materialise(reps.mapInPandas(_coded, "vec_id long, copies long, unit array<double>, cells array<long>"), "vec-coded")

    inside = coded.select("vec_id", F.explode("cells").alias("cell"))
    h = F.xxhash64("vec_id")
    full = inside.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).where("n > 1")
    full = full.groupBy("n", "x", "s").agg(F.min("cell").alias("cell"))
    full = materialise(full.select("cell", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vec-cells")
    calls = -(-int(full.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 1) // CALL)
    met = coded.select("vec_id", "copies", "unit", "cells", F.explode("cells").alias("cell")).join(full, "cell")
    met = met.withColumn("block", F.pmod(F.xxhash64("vec_id", "cell"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.pmod(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")), F.lit(calls)).alias("call"), "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "copies", "unit", "cells")
    seen = materialise(met.groupBy("call").applyInPandas(_compare(similar), "vec_id long, links long, root long"), "vec-links")

    links = seen.groupBy("vec_id").agg(F.sum("links").alias("links"))
    of = components(seen.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vec-components")
    ids = ids.join(links, "vec_id", "left").join(of, ids["vec_id"] == of["node"], "left")
    ids = ids.select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    fine = rows.where("fine").select("vec_id", "h1", "h2")
    linked = hot_join(fine, ids, ["h1", "h2"], "copies", fine.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS k FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.k = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(k) AS component_id, min(k) = r.vec_id AS kept FROM r LEFT JOIN n ON n.x = r.vec_id GROUP BY r.vec_id
"""

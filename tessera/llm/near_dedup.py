"""Near-dedup: BagMinHash signatures of shingle multisets, banded, verified by multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.workers import frugal

from .common import by_slots, col, components, hot_join, materialise, small_batches
from .text import BASE, mixed, shingles, slices

#: Words in a shingle, least weighted Jaccard similarity of a link, bands and signature values in a band.
SIZE, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 6
#: Documents and shingles of a bucket that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 256, 100_000


def bag(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of the distinct hashes of each owner."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def bag_minhash(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of the weighted sets (owner, hash, count); infinite for owners without any.

    Each element has a Poisson process over weight x time. Weight is cut into dyadic blocks
    [0, 1), [1, 2), [2, 4), [4, 8) ...; a block's process has its width as its rate, and each of its points
    gets a unit of weight in the block and one of m places. A signature value is the earliest time
    of a point at its place whose unit is below the element's count. Two bags
    share a value with the probability of their weighted Jaccard similarity: the processes depend
    on the element only, and the earliest point of the union is in both bags just if it lies
    below both counts. Points are made in order of time and a process ends
    when it passes its owner's largest value, so large bags cost little more than one point an element.
    This is the flat variant of the method: the processes of an element's blocks are independent and points above the count
    are rejected, where the original splits one process down a tree of intervals; the distribution is the same.
    """
    sig = np.full(n * m, np.inf)
    level = np.ceil(np.log2(counts)).astype(np.int64) + 1  # blocks that begin below the count
    which = np.repeat(np.arange(len(owner)), level)
    block = np.arange(len(which)) - np.repeat(np.cumsum(level) - level, level)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    room = counts[which] - low  # units of the block that count
    seed = mixed(hashes[which] + block.astype(np.uint64) * np.uint64(BASE))
    own, at, step, made = owner[which], np.zeros(len(which)), 1, 0
    while len(own):
        x = mixed(seed[:, None] + np.arange(made + 1, made + step + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
        gaps = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        time = at[:, None] + np.cumsum(gaps, axis=1)
        y = mixed(x + np.uint64(BASE))
        unit = ((y >> np.uint64(32)) * width[:, None].astype(np.uint64)) >> np.uint64(32)
        place = ((y & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        counted = unit < room[:, None].astype(np.uint64)
        np.minimum.at(sig, (own[:, None] * m + place.astype(np.int64))[counted], time[counted])
        at, made = time[:, -1], made + step
        step = min(16, max(1, made))  # the same steps for every element: equal sums, equal times
        on = at < sig.reshape(n, m).max(axis=1)[own]
        own, at, seed, width, room = own[on], at[on], seed[on], width[on], room[on]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) of 64-bit keys; equal where all values of a band are equal."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    for k in range(rows):
        key = mixed(key * np.uint64(BASE) + bits[:, :, k])
    return key.view(np.int64)


def _signed(bands: int, rows: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts):
                some = texts[part]
                owner, hashes, (word, bounds) = shingles(some, size)
                sig = bag_minhash(*bag(owner, hashes), len(some), bands * rows)
                keys = band_keys(sig, bands, rows)
                n = np.bincount(owner, minlength=len(some))
                norm = [hashlib.blake2b(word[a:b].tobytes(), digest_size=16).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].to_numpy(), "text_hash": batch["text_hash"].iloc[part].to_numpy(), "norm": norm, "n": n, "bands": list(keys)})

    return run


def overlaps(texts: Sequence[str], size: int = SIZE, columns: int = 4096) -> np.ndarray:
    """(n, n) weighted Jaccard similarities of the texts' shingle multisets; 0 if either has no words.

    The overlap of two bags is the sum of the smaller counts: over the columns (shingle, count that occurs), the product
    of who has at least that count, times what it is above the next smaller one.
    """
    owner, hashes, counts = bag(*shingles(texts, size)[:2])
    total = np.bincount(owner, counts, len(texts))
    order = np.lexsort((counts, hashes))
    owner, hashes, counts = owner[order], hashes[order], counts[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    higher = first.copy()
    higher[1:] |= counts[1:] != counts[:-1]
    step = np.flatnonzero(higher)
    level = np.cumsum(higher) - 1  # of each entry; an entry is in its own level's column and in its shingle's lower ones
    below = level - level[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    weight = counts[step] - np.where(first[step], 0, counts[np.maximum(step - 1, 0)])
    row = np.repeat(owner, below + 1)
    column = np.repeat(level, below + 1) - (np.arange(len(row)) - np.repeat(np.cumsum(below + 1) - below - 1, below + 1))
    met = np.bincount(column, minlength=len(step)) > 1
    place = np.cumsum(met) - 1
    use = met[column]
    row, column, weight = row[use], place[column[use]], weight[met]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(texts), len(texts)))
    for at in range(0, len(weight), columns):
        part = slice(*np.searchsorted(column, [at, at + columns]))
        has = np.zeros((len(texts), min(columns, len(weight) - at)))
        has[row[part], column[part] - at] = 1
        both += (has * weight[at : at + columns]) @ has.T
    np.fill_diagonal(both, total)
    return both / np.maximum(total[:, None] + total[None, :] - both, 1)


def _compare(similar: float, size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """(a, b) for each document of one bucket, or of two blocks of a large one, that links to another: b is the smallest id it reaches there."""
        ids = rows["doc_id"].to_numpy()
        linked = overlaps(rows["text"].tolist(), size) >= similar
        np.fill_diagonal(linked, False)
        root, was = ids.copy(), None
        while was is None or (root != was).any():
            was = root
            root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        some = linked.any(axis=1)
        return pd.DataFrame({"a": ids[some], "b": root[some]})

    return run


def against_first(texts: Sequence[str], size: int = SIZE) -> np.ndarray:
    """Weighted Jaccard similarity of each text's shingle multiset with that of the first one."""
    owner, hashes, counts = bag(*shingles(texts, size)[:2])
    total = np.bincount(owner, counts, len(texts))
    own, n = hashes[owner == 0], counts[owner == 0]
    if not len(own):
        return np.zeros(len(texts))
    at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    both = np.bincount(owner, np.where(own[at] == hashes, np.minimum(counts, n[at]), 0), len(texts))
    return both / np.maximum(total + total[0] - both, 1)


def _star(similar: float, size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """(a, b) for each document of a block that links to the block's hub b, in slices of some MB."""
        hub, out = int(key[0]), []
        first = rows["doc_id"].to_numpy() == hub
        ids, texts, hub_text = rows["doc_id"].to_numpy()[~first], rows["text"].to_numpy()[~first].tolist(), rows["text"].to_numpy()[first][0]
        for part in slices(texts, 1 << 20):
            out.append(ids[part][against_first([hub_text, *texts[part]], size)[1:] >= similar])
        linked = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
        return pd.DataFrame({"a": linked, "b": np.full(len(linked), hub)})

    return run


def _texts_of(met: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the documents in ``met``, each once: other texts hardly move.

    Rows that repeat an id and its text become one before the shuffle, as far as they are in one partition.
    """
    some, _ = by_slots(rows, met.select(F.xxhash64("doc_id", "text_hash").alias("k")), F.xxhash64("doc_id", "text_hash"))
    return some.groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"))


def _stars(met: DataFrame, rows: DataFrame, similar: float, size: int) -> DataFrame:
    """Links (a, b) of documents to hubs: each document is compared with one other of its buckets, the one with most neighbours.

    Each text moves once, and once more for every BLOCK documents of a hub. These links settle most documents of
    groups of near copies, so that few buckets are left to be compared in full.
    """
    total = met.count()
    scores = met.groupBy("doc_id", "text_hash").agg(F.sum("c").alias("score"))
    scored = materialise(met.join(scores, ["doc_id", "text_hash"]), "near-scored")
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", "doc_id", "text_hash")).alias("hub"), F.count("*").alias("c"))
    near = hot_join(scored.select("key", "doc_id", "text_hash", "n"), hubs, ["key"], "c", total).where("hub.doc_id <> doc_id")
    chosen = near.groupBy("doc_id", "text_hash", "n").agg(F.max("hub").alias("hub"))
    chosen = materialise(chosen.select("doc_id", "text_hash", "n", F.col("hub.doc_id").alias("hub"), F.col("hub.text_hash").alias("hub_hash")), "near-hubs")
    each = chosen.groupBy("hub", "hub_hash").agg(F.count("*").alias("c"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = hot_join(chosen, each, ["hub", "hub_hash"], "c", chosen.count())
    members = members.select("hub", "hub_hash", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("blocks")).cast("int").alias("block"), "doc_id", "text_hash")
    own = members.select("hub", "hub_hash", "block").distinct().select("*", F.col("hub").alias("doc_id"), F.col("hub_hash").alias("text_hash"))
    placed = materialise(members.union(own), "near-placed")
    texts = placed.join(_texts_of(placed, rows), ["doc_id", "text_hash"])
    return materialise(texts.groupBy("hub", "hub_hash", "block").applyInPandas(_star(similar, size), "a long, b long"), "near-star-links")


def _blocks(met: DataFrame, rows: DataFrame, similar: float, size: int) -> DataFrame:
    """Links (a, b) that span all links inside the buckets of ``met``, each compared in full; large ones in blocks, each two of which are a task."""
    h = F.xxhash64("doc_id", "text_hash")
    buckets = met.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("y"))
    buckets = buckets.groupBy("c", "s", "x", "y").agg(F.min("key").alias("key"))  # buckets of the same documents are one
    buckets = materialise(buckets.select("key", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "near-cut")
    met = met.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = materialise(met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "text_hash"), "near-met")
    texts = met.join(_texts_of(met, rows), ["doc_id", "text_hash"])
    links = texts.groupBy("key", "i", "j").applyInPandas(_compare(similar, size), "a long, b long")
    return materialise(links.distinct(), "near-links")


def text_hash(text: Column) -> Column:
    """The hash that, with the id, tells rows apart; null text as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, with_hash: bool = False) -> DataFrame:
    """(doc_id, class_id, kept): one row for each row; the smallest id of a class stays.

    Words are runs of letters, digits and _, lower-cased; texts of the same words in the same order
    are copies and enter as one. Texts link if the multisets of their runs of ``size``
    words (shorter texts: the run of all words) have a weighted Jaccard similarity of ``similar``; classes are
    the connected components of the links found.

    BagMinHash signatures are cut into ``bands`` of ``rows`` values; texts that share a band
    are candidates (a pair at 0.8 is missed with a probability of 6e-5). First each text is compared with the
    best connected one of its buckets. Buckets whose texts these links connect are done, as more links could not change a
    class; all texts of the others are compared in full, on their whole multisets. Only a spanning forest of a bucket's links leaves its
    task, so no list of pairs is made. Buckets that hold the same texts are one, and a large bucket is cut into
    blocks of about BLOCK texts or BLOCK_SHINGLES shingles, each two of which are a task: g different texts in one
    bucket that is not done at first are copied g / BLOCK times each.

    Null text counts as empty; texts without words are alone in their class. Null ids are
    in no class (class_id null, kept). Ids should be unique: rows that repeat an id and its text enter
    as one and share their fate. A very long text is one row: its task holds it and its shingles. Other columns are not read. An empty table
    gives an empty result. ``with_hash`` adds ``text_hash``, which with the id tells rows apart.
    """
    spark = docs.sparkSession
    rows_in = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows_in = rows_in.withColumn("text_hash", text_hash(F.col("text")))
    with small_batches(spark):
        signed = rows_in.mapInPandas(frugal(_signed(bands, rows, size)), "doc_id long, text_hash long, norm string, n long, bands array<long>")
        signed = materialise(signed, "near-signed")
        named = signed.where("n > 0 and doc_id is not null")
        # one row for each norm, however often a row is repeated; combined before the shuffle
        first = named.groupBy("norm").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("r"), F.count("*").alias("copies"))
        first = materialise(first.select("norm", "copies", "r.*"), "near-first")
        reps = first.select("norm", F.col("doc_id").alias("rep"), "copies")
        banded = first.select("doc_id", "text_hash", "n", F.explode("bands").alias("key"))
        # written, not only joined: with a plain scan on that side adaptive execution can split a hot bucket's rows
        full = materialise(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "near-full")
        banded, _ = by_slots(banded, full.select("key"), F.col("key"))  # most rows are alone in their bucket and stay where they are
        met = materialise(banded.join(full, "key").select("key", "doc_id", "text_hash", "n", "c"), "near-buckets")

        stars = components(_stars(met, rows_in, similar, size), "near-stars")
        at = met.join(stars, met["doc_id"] == stars["node"], "left").select("key", "doc_id", "text_hash", "n", F.coalesce("component", "doc_id").alias("of"))
        at = materialise(at, "near-at")
        mixed = materialise(at.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("key"), "near-mixed")
        more = None
        if not mixed.isEmpty():
            links = _blocks(at.join(mixed, "key", "left_semi").select("key", "doc_id", "text_hash", "n"), rows_in, similar, size)
            # the second graph has the first one's components as its nodes
            of = stars.select(F.struct("node", "component").alias("s"))
            joined = links.join(of.withColumnRenamed("s", "sa"), F.col("a") == F.col("sa.node"), "left").join(of.withColumnRenamed("s", "sb"), F.col("b") == F.col("sb.node"), "left")
            more = components(joined.select(F.coalesce("sa.component", "a").alias("a"), F.coalesce("sb.component", "b").alias("b")).where("a <> b"), "near-classes")

    reps = reps.join(stars, reps["rep"] == stars["node"], "left").select("norm", "copies", F.coalesce("component", "rep").alias("class_id"))
    if more is not None:
        reps = reps.join(more, reps["class_id"] == more["node"], "left").select("norm", "copies", F.coalesce("component", "class_id").alias("class_id"))
    linked = hot_join(named.select("doc_id", "text_hash", "norm"), reps, ["norm"], "copies", named.count()).select("doc_id", "text_hash", "class_id")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"))
    return linked.union(alone).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), *["text_hash"] * with_hash)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS g FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN t tx ON tx.doc_id = x JOIN t ty ON ty.doc_id = y WHERE 5 * m >= 4 * (tx.n + ty.n - m)),
r AS (SELECT doc_id, doc_id AS k FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.k = l.x)
SELECT doc_id, min(k) AS class_id, min(k) = doc_id AS kept FROM r GROUP BY doc_id
"""

"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.workers import frugal

from .common import col, lower_batches, small_batches
from .text import BASE, folded, mixed, slices

#: Buckets of the embedding table, its width, and the subwords' lengths in characters.
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (1, 2, 3, 4)
#: Bounds of the labelled sample that one task fits on: about so many rows of a language and in all, texts of so many characters at most, so many languages.
SAMPLE, SAMPLE_ALL, SAMPLE_CHARS, LANGUAGES = 1500, 6000, 20_000, 256
#: Characters that the sample has at most in all: rows are drawn at a lower rate where texts are long.
SAMPLE_MB = 40
#: Labelled rows under which only texts without letters are rejected; share of them that the calibrated test may reject; share of rows of a left-out language that should be caught; room above the first.
LEAST_ROWS, REJECTED, CAUGHT, MARGIN = 50, 0.001, 0.99, 1.15
#: Subwords of at least this length are judged for being known, the weight of one that was never seen, and how many known ones a text gets on top, so that short texts are not rejected for a name.
LONG, UNSEEN, GIVEN = 3, 0.5, 4


def subwords(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(bucket numbers for each length of subword, bounds, letters): subwords of lower-cased letters with their word's edges as spaces.

    All lengths' arrays are as long as the folded text; a place where no subword of a length begins has
    bucket BUCKETS, which holds nothing.
    """
    flat, bounds = folded(texts, "letter")
    space = flat == 32
    out, h = [], np.zeros(len(flat), np.uint64)
    wide = np.concatenate([flat, np.full(max(GRAMS), 32, np.uint32)]).astype(np.uint64)
    gap = np.concatenate([space, np.ones(max(GRAMS), bool)])
    bad = np.zeros(len(flat), bool)  # the subword has a space inside, or is one
    for n in range(1, max(GRAMS) + 1):
        h = h * np.uint64(BASE) + wide[n - 1 : n - 1 + len(flat)] + np.uint64(1)
        if n > 2:
            bad = bad | gap[n - 2 : n - 2 + len(flat)]
        if n in GRAMS:
            gram = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            none = space if n == 1 else space & gap[1 : 1 + len(flat)] if n == 2 else bad
            out.append(np.where(none, BUCKETS, gram.astype(np.int64)))
    letters = np.diff(np.concatenate([[0], np.cumsum(~space)])[np.append(bounds[:-1], len(flat))])
    return out, bounds, letters


@dataclass
class Model:
    """``table`` (BUCKETS + 1, languages) holds each bucket's embedding times the softmax weights: averaging either is the same.

    ``usual`` holds for each bucket the logarithm of how many times as frequent it is in the learned languages as in a background that has all buckets
    alike. The softmax shares all probability among the languages that it knows, however foreign a text is; so a text is rejected if the mean of its subwords in
    ``usual`` is over ``slack`` standard deviations below ``mean``. Their variance has a part of the text, and one that falls with the number of different subwords.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    usual: np.ndarray
    mean: float = 0.0
    of_texts: float = 0.0
    of_subwords: float = 0.0
    slack: float = np.inf

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, letters, standard deviations below the mean of known texts) of each text, from all its subwords."""
        k = len(self.languages)
        out, letters, strange = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for part in slices(texts, 1 << 18):
            grams, bounds, letters[part] = subwords(texts[part])
            sums, n = np.zeros((part.stop - part.start, k)), np.zeros(part.stop - part.start)
            for g in grams:
                sums += np.add.reduceat(self.table[g], bounds[:-1], axis=0, dtype=np.float64)
                n += np.add.reduceat(g < BUCKETS, bounds[:-1], dtype=np.int64)
            out[part] = sums / np.maximum(n, 1)[:, None] + self.bias
            mean, different, _ = familiar(grams, bounds, self.usual)
            strange[part] = self.below(mean, different)
        return out, letters, strange

    def below(self, mean: np.ndarray, different: np.ndarray) -> np.ndarray:
        """How many standard deviations ``mean`` of so many different subwords is below that of known texts, when GIVEN known ones are added; 0 without subwords."""
        spread = np.sqrt(self.of_texts + self.of_subwords / np.maximum(different, 1))
        return (self.mean - mean) / np.maximum(spread, 1e-9) * different / (different + GIVEN)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text; ``und`` with score 0, rejected, for texts without letters."""
        logits, letters, strange = self.logits(texts)
        if not self.languages:
            return np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = softmax(logits / self.temperature)
        best, some = p.argmax(axis=1), letters > 0
        score = np.where(some, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        return np.where(some, np.array(self.languages, object)[best], "und"), score, ~some | (strange > self.slack)


def familiar(grams: list[np.ndarray], bounds: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, different, variance) of the values in ``usual`` of each text's subwords of LONG characters or more."""
    texts = len(bounds) - 1
    n, total, square, different = np.zeros((4, texts))
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    for size, g in zip(GRAMS, grams, strict=True):
        if size >= LONG:
            value = usual[g].astype(np.float64)  # 0 where no subword begins
            n += np.add.reduceat(g < BUCKETS, bounds[:-1], dtype=np.int64)
            total += np.add.reduceat(value, bounds[:-1])
            square += np.add.reduceat(value**2, bounds[:-1])
            real = g[: bounds[-1]] < BUCKETS
            seen = np.unique(owner[real] * (BUCKETS + 1) + g[: bounds[-1]][real])
            different += np.bincount(seen // (BUCKETS + 1), minlength=texts)
    n, total, square = (np.where(different > 0, x, 0) for x in (n, total, square))
    mean = total / np.maximum(n, 1)
    return mean, different, np.maximum(square / np.maximum(n, 1) - mean**2, 0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], *, epochs: int = 4, least_steps: int = 400, rate: float = 1.0, batch: int = 32, seed: int = 1) -> Model:
    """Stochastic gradient descent on four fifths of the rows; the rest set the temperature and the rejection."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, np.zeros(BUCKETS + 1, np.float32))
    label = np.array([names.index(x) for x in langs])
    grams = bags(texts, min(GRAMS))
    rng = np.random.default_rng(seed)
    order = rng.permutation([k for k, (ids, _) in enumerate(grams) if len(ids)])
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    epochs = max(epochs, -(-least_steps * batch // max(1, len(train))))  # few rows: more passes
    steps, step = epochs * (len(train) // batch + 1), 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            ids = np.concatenate([grams[k][0] for k in rows]).astype(np.int64)
            share = np.concatenate([(grams[k][1] / max(1, grams[k][1].sum(dtype=np.int64))).astype(np.float32) for k in rows])
            starts = np.cumsum([0, *(len(grams[k][0]) for k in rows[:-1])])
            mean = np.add.reduceat(table[ids] * share[:, None], starts)
            error = softmax(mean @ weight + bias)
            error[np.arange(len(rows)), label[rows]] -= 1
            r = np.float32(rate * (1 - step / steps) * 20 / len(rows))
            step += 1
            back = error @ weight.T
            weight -= r * (mean.T @ error) / 4
            bias -= r * error.sum(axis=0) / 20
            own = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(ids))))
            np.add.at(table, ids, -r * share[:, None] * back[own])
    table[BUCKETS] = 0
    model = Model(names, np.ascontiguousarray((table @ weight).astype(np.float32)), bias.astype(np.float64), 1.0, np.zeros(BUCKETS + 1, np.float32))
    if len(held):
        logits, _, _ = model.logits([texts[k] for k in held])
        loss = lambda t: -np.mean(np.log(softmax(logits / t)[np.arange(len(held)), label[held]] + 1e-12))
        model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    del grams  # before the longer subwords are counted, in a pass of their own: they take nearly as much
    long = bags(texts, LONG)
    calibrate(model, [long[k] for k in order], label[order])
    return model


def bags(texts: list[str], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``counted`` gives for each text's subwords of ``least`` characters or more."""
    out = []
    for part in slices(texts, 1 << 18):
        grams, bounds, _ = subwords(texts[part])
        grams = [x for size, x in zip(GRAMS, grams, strict=True) if size >= least]
        out += [counted([x[a:b] for x in grams]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, times) of a text's subwords, in as few bytes as they take: the task that fits holds those of the whole sample."""
    ids, n = np.unique(np.concatenate(grams), return_counts=True)
    real = ids < BUCKETS
    return ids[real].astype(np.min_scalar_type(BUCKETS - 1)), n[real].astype(np.min_scalar_type(int(n.max(initial=0))))


def usual_of(counts: np.ndarray) -> np.ndarray:
    """Logarithm of each bucket's frequency against a background of all buckets alike."""
    out = np.log((counts + UNSEEN) / (counts.sum() + UNSEEN * BUCKETS) * BUCKETS).astype(np.float32)
    out[BUCKETS] = 0
    return out


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> None:
    """What is usual, and how far below the mean of known texts a text may be; ``rows`` are (buckets, counts) of the labelled texts' longer subwords.

    Each row is judged by what the other fifths of the rows hold. For what is foreign each language is left out in turn: its texts then stand for a language that was never learned.
    The limit lies half way between what rejects REJECTED of the known texts and what catches CAUGHT of the left-out ones, and above the former by MARGIN at least.
    With fewer than LEAST_ROWS rows to go by, nothing that has letters is rejected.
    """
    part, n = np.arange(len(rows)) % 5, np.array([len(ids) for ids, _ in rows], np.int64)

    def blocks(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, buckets, counts) of those rows that have any, a few at a time."""
        for k in np.array_split(np.flatnonzero(some & (n > 0)), 1 + n[some].sum() // (1 << 18)):
            if len(k):
                yield k, np.concatenate([rows[i][0] for i in k]), np.concatenate([rows[i][1] for i in k]).astype(np.int64)

    def counts(some: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS + 1)
        for _, ids, times in blocks(some):
            out += np.bincount(ids, times, BUCKETS + 1)
        return out

    total = counts(np.ones(len(rows), bool))
    model.usual = usual_of(total)
    if (n > 0).sum() < LEAST_ROWS:
        return

    def judged(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, variance) of each row by what all rows of other groups hold."""
        sums = np.zeros((3, len(rows)))
        for g in np.unique(groups):
            usual = usual_of(total - counts(groups == g))
            for k, ids, times in blocks(groups == g):
                value, first = usual[ids].astype(np.float64), np.cumsum(n[k]) - n[k]
                sums[:, k] = [np.add.reduceat(x, first) for x in (times, times * value, times * value**2)]
        sums = sums[:, n > 0]
        mean = sums[1] / sums[0]
        return mean, np.maximum(sums[2] / sums[0] - mean**2, 0)

    mean, variance = judged(part)
    different = n[n > 0]
    model.mean, model.of_subwords = float(np.median(mean)), float(np.median(variance))
    model.of_texts = float(max(0.0, np.mean((mean - model.mean) ** 2 - model.of_subwords / different)))
    near = far = max(0.0, float(np.quantile(model.below(mean, different), 1 - REJECTED)))
    if len(model.languages) > 1:
        far = float(np.quantile(model.below(judged(label)[0], different), 1 - CAUGHT))
    model.slack = max(near * MARGIN, (near + far) / 2)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the labelled rows of ``docs``, fitted on a sample whose bounds are the constants above.

    Rows are picked by a hash of their id at a rate that makes about SAMPLE rows of each language (fewer if there are many, or if texts are long:
    about SAMPLE_MB million characters in all), at most 2 * SAMPLE_ALL in all; rarer languages enter whole. The LANGUAGES most frequent languages are learned.
    A task fits the model, so that the driver gets it alone (BUCKETS x LANGUAGES floats at most) and never holds the sample.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.length("text") <= SAMPLE_CHARS)
    stats = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not stats:
        return fit([], [])
    share, mb = min(SAMPLE, SAMPLE_ALL // len(stats)), SAMPLE_MB * 1e6 / len(stats)
    rate = F.create_map(*[F.lit(x) for lang, r in stats.items() for x in (lang, min(1.0, share / r["n"], mb / max(r["chars"], 1)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.where(draw < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(0.0)))
    sample = picked.limit(2 * SAMPLE_ALL).coalesce(1)  # Spark drops a limit that it knows to be met
    sample = sample.sortWithinPartitions(F.asc_nulls_first("doc_id"), "lang", "text").select("text", "lang")
    with small_batches(docs.sparkSession):
        made = sample.mapInPandas(frugal(_fitted), "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], [])


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts, langs = [], []
    for batch in batches:
        texts += batch["text"].tolist()
        langs += batch["lang"].tolist()
    yield pd.DataFrame({"model": [pickle.dumps(fit(texts, langs))]})


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "lang_id") -> DataFrame:
    """``docs`` with a column ``out_col``: struct of lang (``und`` if the text is null or has no letters), score 0 to 1, rejected.

    Every subword of the whole text counts. Scores are probabilities at the calibrated
    temperature; ``rejected`` texts have no letters, or subwords that are too rare in the languages learned, by a limit that allows more for short texts.
    Null ids and repeated rows are judged by their text. A very long text is one row: its task holds some dozen bytes for each character.
    An empty table gives an empty result; other columns pass through unread.
    """
    lower_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x LANGUAGES floats at most: 64 MB

    @frugal
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score, rejected = shared.value.predict(["" if x is None else x for x in texts])
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    @F.pandas_udf("lang string, score double, rejected boolean")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return predicted(batches)

    return docs.withColumn(out_col, label(col(text_col)))


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"), F.col("lang_id.rejected").alias("rejected"))

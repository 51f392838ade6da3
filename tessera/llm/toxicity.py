"""Toxicity: a classifier learned from confirmed toxic texts and unlabelled ones, by non-negative positive-unlabelled risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, lower_batches
from .text import BASE, folded, mixed, slices

#: Bounds of what the driver fits on: rows of either kind, characters in all, characters of a text. Longer texts are scored, whole, but not learned from.
POSITIVES, UNLABELLED, SAMPLE_CHARS, TEXT_CHARS = 2000, 6000, 20_000_000, 20_000
#: Features are whole words and beginnings of words of these lengths in characters, hashed into so many buckets; the most telling are kept.
BEGINNINGS, BUCKETS, FEATURES = (3, 4, 5, 6, 7, 8), 1 << 22, 2048
#: A bucket is kept if the share of toxic texts that hold it is so many standard errors from that of unlabelled ones, and so many toxic texts or unlabelled ones hold it.
ERRORS, HELD_BY = 4.0, 3
#: Share of toxic texts that is taken where no row is labelled 0, so that labels can't tell it.
PRIOR = 0.1
#: Classifiers, each fitted on the rows of all folds but one; steps, rows of either kind in a step, rate and penalty of each fit.
FOLDS, STEPS, BATCH, RATE, PENALTY = 3, 600, (256, 768), 0.05, 1e-4


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of each word's beginnings and of each whole word, a kind at a time."""
    flat, bounds = folded(texts, "word")
    spaces = np.flatnonzero(flat == 32)
    begin, length = spaces[:-1] + 1, np.diff(spaces) - 1
    owner = np.searchsorted(bounds, begin, side="right") - 1
    wide = np.concatenate([flat, np.full(max(BEGINNINGS), 32, np.uint32)]).astype(np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(begin), np.uint64)
    for n in range(1, max(BEGINNINGS) + 1):
        h = h * np.uint64(BASE) + wide[begin + n - 1] + np.uint64(1)
        if n in BEGINNINGS:
            some = length >= n
            yield owner[some], (mixed(h[some] + np.uint64(n)) >> shift).astype(np.int64)
        if n > 1:
            whole = length == n  # the word ends here
            yield owner[whole], (mixed(~h[whole]) >> shift).astype(np.int64)
    long = length > max(BEGINNINGS)
    rest = np.zeros(long.sum(), np.uint64)
    if len(rest):  # the other characters of long words, by differences of running sums
        powers = np.full(1 << int(length.max()).bit_length(), BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        at, n = begin[long], length[long]
        for k in range(max(BEGINNINGS), int(n.max())):
            inside = n > k
            rest[inside] += mixed(wide[at[inside] + k]) * powers[k]
        yield owner[long], (mixed(~(h[long] + mixed(rest))) >> shift).astype(np.int64)


@dataclass
class Model:
    """Logistic classifier over how often a text holds each of ``kept`` buckets, and how many words it has."""

    kept: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text, from 0 to 1. Texts without words get the one that no evidence gives."""
        out = np.zeros(len(texts))
        for part in slices(texts):
            out[part] = counted(texts[part], self.kept) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def counted(texts: list[str], kept: np.ndarray) -> np.ndarray:
    """(texts, kept + 1): logarithms of one more than the counts of the kept buckets, and of the words, scaled."""
    out = np.zeros((len(texts), len(kept) + 1), np.float32)
    for owner, bucket in features(texts):
        at = np.searchsorted(kept, bucket)
        hit = at < len(kept)
        hit[hit] = kept[at[hit]] == bucket[hit]
        np.add.at(out, (owner[hit], at[hit]), 1)
    flat, bounds = folded(texts, "word")
    out[:, -1] = np.diff(np.concatenate([[0], np.cumsum(flat == 32)])[bounds])
    np.log1p(out, out=out)
    out[:, -1] /= 10
    return out


def _held_by(texts: list[str]) -> np.ndarray:
    """How many of the texts hold each bucket."""
    out = np.zeros(BUCKETS, np.int32)
    for part in slices(texts):
        owner, bucket = (np.concatenate(x) for x in zip(*features(texts[part]), strict=True))
        np.add.at(out, np.unique(owner * BUCKETS + bucket) % BUCKETS, 1)
    return out


def telling(positive: list[str], unlabelled: list[str]) -> np.ndarray:
    """The buckets that toxic texts hold much more or less often than unlabelled ones, in order."""
    p, u = _held_by(positive), _held_by(unlabelled)
    share = (p + u + 1) / (len(positive) + len(unlabelled) + 2)
    errors = np.abs(p / len(positive) - u / len(unlabelled)) / np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)))
    some = np.flatnonzero((errors >= ERRORS) & (np.maximum(p, u) >= HELD_BY))
    return np.sort(some[np.argsort(-errors[some], kind="stable")[:FEATURES]])


def risk(on_positive: np.ndarray, on_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the logistic risk: that of toxic texts as such, and that of all others, which is the unlabelled texts' less the toxic ones'
    among them. The second is an estimate of something that can't be negative; where it is, the classifier has begun to learn the rows by heart."""
    return prior * float(np.logaddexp(0, -on_positive).mean()), float(np.logaddexp(0, on_unlabelled).mean()) - prior * float(np.logaddexp(0, on_positive).mean())


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """(weights, bias) by stochastic gradient descent, with momentum and steps scaled for each weight, on the non-negative risk.

    While the second part of the risk is negative on a batch, a step goes back up that part instead of down the whole.
    """
    rng, n = np.random.default_rng(seed), positive.shape[1]
    prior = np.float32(prior)
    w, momentum, square = np.zeros((3, n + 1), np.float32)
    w[n] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        p, u = (x[rng.integers(0, len(x), min(len(x), most))] for x, most in zip((positive, unlabelled), BATCH, strict=True))
        on_p, on_u = (np.clip(x @ w[:n] + w[n], -50, 50) for x in (p, u))
        s_p, s_u = 1 / (1 + np.exp(-on_p)), 1 / (1 + np.exp(-on_u))
        mean = lambda error, x: np.append(error @ x, error.sum()) / np.float32(len(x))
        of_others = mean(s_u, u) - prior * mean(s_p, p)
        gradient = -of_others if risk(on_p, on_u, prior)[1] < 0 else prior * mean(s_p - 1, p) + of_others
        gradient[:n] += PENALTY * w[:n]
        momentum = np.float32(0.9) * momentum + np.float32(0.1) * gradient
        square = np.float32(0.999) * square + np.float32(0.001) * gradient**2
        w -= np.float32(RATE * (1 - step / (STEPS + 1)) / (1 - 0.9**step)) * momentum / (np.sqrt(square / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return w[:n], float(w[n])


def threshold(on_positive: np.ndarray, on_unlabelled: np.ndarray, prior: float) -> float:
    """The highest threshold, 0 at most, of least risk: toxic texts that are missed, and unlabelled ones that are found beyond the toxic ones among them."""
    at = np.unique(np.concatenate([[0.0], on_positive, on_unlabelled]))
    at = at[at <= 0]
    found_p, found_u = (1 - np.searchsorted(np.sort(x), at) / len(x) for x in (on_positive, on_unlabelled))
    cost = prior * (1 - found_p) + np.maximum(0, found_u - prior * found_p)
    return float(at[cost <= cost.min() + 1e-12].max())


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """The mean of FOLDS classifiers; the threshold that their held-back rows set becomes the score of one half."""
    prior = min(max(prior, 1e-3), 0.9)
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(1), float(np.log(prior / (1 - prior))))
    kept = telling(positive, unlabelled)
    p, u = (np.concatenate([counted(texts[part], kept) for part in slices(texts)]) for texts in (positive, unlabelled))
    fold_p, fold_u = np.arange(len(p)) % FOLDS, np.arange(len(u)) % FOLDS
    out_p, out_u, fits = np.zeros(len(p)), np.zeros(len(u)), []
    for k in range(FOLDS):
        own_p = fold_p != k if (fold_p != k).any() else fold_p == k  # too few rows for folds: of all
        own_u = fold_u != k if (fold_u != k).any() else fold_u == k
        w, b = descend(p[own_p], u[own_u], prior, k)
        out_p[fold_p == k], out_u[fold_u == k] = p[fold_p == k] @ w + b, u[fold_u == k] @ w + b
        fits.append((w, b))
    weight, bias = (np.mean(x, axis=0) for x in zip(*fits, strict=True))
    return Model(kept, weight, float(bias) - threshold(out_p, out_u, prior))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts of ``docs`` that ``labels`` call toxic (1), and from all texts, as unlabelled ones.

    Rows labelled 0 serve only to tell the share of toxic texts. What the driver fits on is bounded by the constants above: rows are drawn by a hash of id and text, at
    rates that their counts set. A label for several rows of one id counts for each, of several labels of an id the largest counts. Null ids, labels and texts are left out.
    Without a toxic text every score is the share of toxic texts.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    of = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = of.get(1, 0)
    prior = n / (n + of[0]) if of.get(0) else PRIOR
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(11), *c), F.lit(1 << 20)) / float(1 << 20)
    ids = marks.where((F.col("toxic") == 1) & (draw("id") < min(1.0, 4 * POSITIVES / max(n, 1)))).select("id", F.lit(True).alias("toxic")).limit(8 * POSITIVES)
    rows = docs.where(col(id_col).isNotNull() & (F.length(col(text_col)) <= TEXT_CHARS)).select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(ids), "id", "left")
    chars = F.length("text")
    known = rows.agg(F.count("toxic"), F.sum(F.when(F.col("toxic"), chars)), F.count("*"), F.sum(chars)).first()
    rates = [min(1.0, most / max(count, 1), SAMPLE_CHARS / 2 / max(size or 0, 1)) for most, count, size in ((POSITIVES, *known[:2]), (UNLABELLED, *known[2:]))]
    as_toxic, as_unlabelled = F.col("toxic") & (draw("id", "text") < rates[0]), draw("text", "id") < rates[1]
    sample = rows.select("id", "text", F.coalesce(as_toxic, F.lit(False)).alias("p"), as_unlabelled.alias("u")).where("p or u")
    sample = sample.limit(2 * (POSITIVES + UNLABELLED)).toPandas().sort_values(["id", "text"])
    return fit(sample["text"][sample["p"]].tolist(), sample["text"][sample["u"]].tolist(), prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out_col``, in place of one of that name: the probability of being toxic, 0 to 1, at least 0.5 for what is called toxic.

    Every word of the whole text counts; a null text counts as an empty one, whose score is that of no evidence. Null ids and repeated rows are judged by their text.
    A very long text is one row: its task holds some hundred bytes for each character. An empty table gives an empty result; other columns pass through
    unread. There is no shuffle.
    """
    lower_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(["" if x is None else x for x in texts]))

    return docs.withColumn(out_col, run(col(text_col)))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))

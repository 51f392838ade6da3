"""Personal data: fixed patterns as seeds, and bootstrapped contexts that find identifiers the patterns miss."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.workers import frugal

from .common import by_slots, col, cols, fresh, hot_join, lower_batches, materialise, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that contexts find.
FOUND = "id"
#: Shapes of keys that begin in a way of their own. They are found by shape, wherever they stand, and are seeds of contexts.
STARTS = ("AKIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")
KEYS = re.compile(r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z-]{20,}+|xox[abprs]-[0-9A-Za-z-]{10,}+)(?![0-9A-Za-z_-])")
#: A long hexadecimal number is a seed too, but may as well be the name of a revision: contexts must confirm each of them.
HEX = re.compile(r"(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}")
#: Rounds of scoring; a pattern counts from so many known identifiers on (with fewer in a context, what only contexts could tell stays: a table with fewer than SUPPORT such secrets keeps them); least scores of a pattern and of an instance to be believed.
ROUNDS, SUPPORT, PATTERN, INSTANCE = 3, 8, 0.8, 0.9

# Linear forms of the contract's expressions: a possessive run can't match after giving characters back, and no match ends inside a run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
# Words of a context are looked for among the 90 characters before a span; of a word over 40 characters its last (after a span: first) 40 count.
WORD_BEFORE = re.compile(r"(?:(\S{1,40})\s+)?(\S{1,40})\s+[\"'(\[{<]*$")
WORD_AFTER = re.compile(r"\S?\s+(\S{1,40})")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the expression matches, leftmost and non-overlapping, found from each @ outwards."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    out = [("email", *s) for s in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


def keys(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of KEYS that overlap none of ``base``."""
    if not any(x in text for x in STARTS):
        return []
    busy = sorted((s, e) for _, s, e in base)
    spans = []
    for m in KEYS.finditer(text):
        at = bisect_left(busy, (m.end(), 0))
        if not any(e > m.start() for _, e in busy[max(0, at - len(KINDS)) : at]):
            spans.append((FOUND, *m.span()))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: the word before it, the two before, and the words on both sides; lower case, digits as 0, 40 characters of a word at most."""
    before = WORD_BEFORE.search(text[max(0, start - 90) : start])
    after = WORD_AFTER.match(text, end)
    fold = lambda w: DIGITS.sub("0", w.lower())
    if not before:
        return []
    one = fold(before[2])
    out = [f"1 {one}"]
    if before[1]:
        out.append(f"2 {fold(before[1])} {one}")
    if after:
        out.append(f"3 {one} | {fold(after[1])}")
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that look like identifiers and overlap none of ``taken``: without white space, 8 characters or more, 3 digits at least."""
    busy = sorted((s, e) for _, s, e in taken)
    k, done = 0, 0
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        while k < len(busy) and busy[k][1] <= m.start():
            k += 1
        if k < len(busy) and busy[k][0] < m.end():
            continue
        start, end = m.span()
        low = max(done, busy[k - 1][1] if k else 0)
        high = busy[k][0] if k < len(busy) else len(text)
        while start > low and not text[start - 1].isspace() and text[start - 1] not in "=:\"'":
            start -= 1
        while end < high and not text[end].isspace() and text[end] not in "\"'":
            end += 1
        done = end
        while end > start and text[end - 1] in ".,;:!?)]}>":
            end -= 1
        while start < end and text[start] in "([{<":
            start += 1
        if end - start >= 8 and sum(c.isdigit() for c in text[start:end]) >= 3:
            yield start, end


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            base = base_spans(text)
            sure = keys(text, base)
            spans = [(s, e, True, kind != FOUND, kind == FOUND) for kind, s, e in base + sure] + [(s, e, HEX.fullmatch(text, s, e) is not None, False, False) for s, e in candidates(text, base + sure)]
            seen = [{"start": s, "end": e, "seed": seed, "base": is_base, "key": key, "instance": text[s:e], "patterns": contexts(text, s, e)} for s, e, seed, is_base, key in spans]
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            spans = joined(base)
            out.append((doc_id, (part << 40) + row, hashlib.sha256(text.encode()).hexdigest(), *n, hashlib.sha256(spans.encode()).hexdigest(), spans, seen))
            row += 1
        yield pd.DataFrame(out, columns=["doc_id", "row", "text_sha256", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "seen"]).astype({"doc_id": "Int64"})


def discovered(found: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, pattern: float = PATTERN, instance: float = INSTANCE) -> DataFrame:
    """(row, start, end) of spans that match no base kind but stand in contexts where seeds stand.

    The graph has an edge for each pattern and instance that occur together. A seed (a base span, a key, or a long hexadecimal number) has score 1. A
    round scores each pattern by the mean score of its instances (shrunk by two unknown
    ones), if at least ``support`` score well, and then each other instance by its
    believed patterns: one minus the product of their doubts, over two of them at least. What scores ``instance`` by its patterns
    is found, and so is a key of a shape of its own by itself; a hexadecimal number seeds patterns but is no find by itself. Only counts and sums of a pattern or
    instance meet in one place, combined before the shuffle, and go back to the edges of hot ones by broadcast, so a pattern
    or an instance that a third of all edges share is no hot spot.
    """
    seen = found.select("row", F.explode("seen").alias("s")).select("row", "s.start", "s.end", "s.seed", "s.base", "s.key", F.sha2("s.instance", 256).alias("instance"), "s.patterns")
    seen = materialise(seen, "pii-seen")
    edges = materialise(seen.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    total = edges.count()
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("int")).cast("double").alias("score"), F.count("*").alias("edges"))
    for _ in range(rounds):
        scored = hot_join(edges, scores.select("instance", "score", "edges"), ["instance"], "edges", total)
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 2)).alias("p"), F.sum((F.col("score") >= instance).cast("int")).alias("n"), F.count("*").alias("edges"))
        believed = materialise(patterns.where((F.col("n") >= support) & (F.col("p") >= pattern)).select("pattern", "p", "edges"), "pii-patterns")
        doubts = hot_join(edges, believed, ["pattern"], "edges", total, "left").groupBy("instance").agg(F.max("seed").alias("seed"), F.count("p").alias("n"), F.sum(F.log(F.lit(1.0) - F.least("p", F.lit(0.999)))).alias("d"), F.count("*").alias("edges"))
        by_context = F.when(F.col("n") >= 2, 1.0 - F.exp("d")).otherwise(0.0)
        scores = materialise(doubts.select("instance", F.when(F.col("seed"), 1.0).otherwise(by_context).alias("score"), by_context.alias("context"), "edges"), "pii-scores")
    open_spans = seen.where("not base and not key").select("row", "start", "end", "instance")
    sure = scores.where(F.col("context") >= instance).select("instance")
    sure = open_spans.groupBy("instance").agg(F.count("*").alias("spans")).join(sure, "instance")
    return hot_join(open_spans, sure, ["instance"], "spans", open_spans.count()).select("row", "start", "end").union(seen.where("key").select("row", "start", "end"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What ``find`` gives, and ``text_sha256``: rows of equal texts have equal spans, whatever their ids."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    n = ", ".join(f"n_{k} long" for k in KINDS)
    seen = "seen array<struct<start: int, end: int, seed: boolean, base: boolean, key: boolean, instance: string, patterns: array<string>>>"
    with small_batches(docs.sparkSession):
        found = materialise(rows.mapInPandas(frugal(_find), f"doc_id long, row long, text_sha256 string, {n}, base_sha256 string, base string, {seen}"), "pii-found")
    more = discovered(found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("more"))
    text = F.transform("more", lambda s: F.concat_ws(":", F.lit(FOUND), s["start"].cast("string"), s["end"].cast("string")))
    out = found.drop("seen").join(more, "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(text, ","))
    return out.select("doc_id", "text_sha256", *[f"n_{k}" for k in KINDS], "base_sha256", "base", F.coalesce(spans, F.lit("")).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_id"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, spans, n_id), one row for each row.

    ``base`` are the spans of the fixed patterns, ``spans`` those and the discovered ones (kind
    ``id``, last), as kind:start:end in code points, end exclusive. Null text counts as empty, null ids are kept, repeated
    rows give repeated results, other columns are not read, an empty table gives an empty result. A very long text is one row: its
    task holds it and its spans.
    """
    return _spans(docs, id_col, text_col).drop("text_sha256")


def masked(text: str, spans: str) -> str:
    """``text`` with each span (kind:start:end, joined by commas) as its kind in brackets; what overlaps is one, of the first kind."""
    parts, at = [], 0
    for start, end, kind in sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if -end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = -end
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans that ``find`` gives masked in the text; texts without any, and all other columns, as they were.

    Spans meet their rows by the hash of the text, not by id: null ids, repeated ids and ids on several texts are all
    masked by their own text. Only texts with spans are shuffled to meet them: a bit set of fixed size tells which; texts
    that make up over a thousandth of those rows meet theirs by broadcast. A null text stays null.
    """

    @frugal
    def covered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([masked(t, s) for t, s in zip(texts, spans, strict=True)])

    @F.pandas_udf("string")
    def cover(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return covered(batches)

    lower_batches(docs.sparkSession)
    found = _spans(docs, id_col, text_col)
    names, text = cols(docs), col(text_col)
    key, spans, count = (fresh(docs, f"_pii_{x}") for x in ("sha", "spans", "count"))
    hits = materialise(found.where("spans <> ''").groupBy(F.col("text_sha256").alias(key)).agg(F.max("spans").alias(spans), F.count("*").alias(count)), "pii-hits")
    dirty, clean = by_slots(docs, hits.select(key), F.sha2(F.coalesce(text, F.lit("")), 256))
    total = hits.agg(F.sum(count)).first()[0] or 0
    dirty = hot_join(dirty.select(*names, F.sha2(F.coalesce(text, F.lit("")), 256).alias(key)), hits, [key], count, total, "left")
    done = F.when(F.col(spans).isNotNull() & text.isNotNull(), cover(F.coalesce(text, F.lit("")), F.coalesce(spans, F.lit("")))).otherwise(text)
    return clean.unionByName(dirty.select(*[done.alias(c) if c == text_col else col(c) for c in docs.columns]))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_id")

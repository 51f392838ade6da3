"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, hot_join, materialise

#: Words of 64 bits in a block of the filter; a key sets one bit in each.
WORDS = 8
#: Largest filter in bytes. A longer list makes the filter denser, never larger: the exact join still gives the same result.
MOST_BYTES = 32 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what is between the first ``://`` and the next of / ? #, with A-Z lower-cased, and from there to ? or #.

    Null, or no ``://``: both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _bit(word: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftright(h2, {word * 6}) & 63 as int))")


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """Adds block and h2: where the key's bits are; six bits of h2 for each word of the block."""
    return df.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("h2", F.xxhash64("key", F.lit(7)))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column ``key``: (block, w0..w7), at most ``blocks`` rows."""
    return _hashed(keys, blocks).groupBy("block").agg(*[F.bit_or(_bit(k)).alias(f"w{k}") for k in range(WORDS)])


def url_filter(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", bits_per_key: int = 12) -> DataFrame:
    """(host, path, rule, verdict, n) for each distinct (host, path) of ``pages``, which n rows have.

    ``rules`` has the columns host, path and verdict. A rule fits its host and all subdomains
    if the url's path starts with the rule's; the longest rule wins, of equally long ones the
    longer host, then a block. Urls that no rule fits get a null rule and are allowed.

    Each distinct url gives its candidate keys: its host's suffixes (as many labels at most
    as a rule has) with its path's prefixes (of lengths that rules have). Candidates that the
    blocked Bloom filter passes meet the list in an exact hash join, which removes its false
    positives. The filter is broadcast, at most MOST_BYTES; so are, in both joins, only keys and urls that over a thousandth of the rows
    share, such as a rule for ``com`` or the empty url: no key meets in one task. Rules with a null host, path or verdict are ignored; repeated ones
    count once. A url of any length is judged whole. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" over "allow"
    rules = rules.withColumn("key", F.concat("host", F.lit("\n"), "path"))
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = split_url(col(url_col))
    urls = materialise(pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")), "url-distinct")
    if not shape.n:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), "n")
    blocks = max(1, min(shape.n * bits_per_key // (64 * WORDS) + 1, MOST_BYTES // (8 * WORDS + 8)))

    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(shape.labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    lengths = F.from_json(F.lit(json.dumps(shape.lengths)), "array<int>")
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    tried = _hashed(urls.select("host", "path", F.explode(keys).alias("key")), blocks)
    maybe = tried.join(F.broadcast(bloom(rules, blocks)), "block")  # at most MOST_BYTES
    for k in range(WORDS):
        maybe = maybe.where(F.col(f"w{k}").bitwiseAND(_bit(k)) != 0)
    listed = rules.select("key", F.concat("host", "path").alias("rule"), F.length("host").alias("host_n"), F.col("verdict").alias("said"))
    maybe = materialise(maybe.select("host", "path", "key"), "url-maybe")
    met = maybe.groupBy("key").agg(F.count("*").alias("hits")).join(listed, "key")
    hits = hot_join(maybe, met, ["key"], "hits", maybe.count())
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_n", "said", "rule")).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit("allow")).alias("verdict"), "n")


def judge_pages(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``; see ``url_filter``.

    Null ids are kept, repeated rows give repeated results, an empty table gives none.
    """
    host, path = split_url(col(url_col))
    judged = materialise(url_filter(pages, rules, url_col=url_col), "url-judged")
    rows = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return hot_join(rows, judged, ["host", "path"], "n", total).select("page_id", "host", "path", "rule", "verdict")


#: The rules of the contract: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    text = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<host:string,path:string,verdict:string>>")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


OP4_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(v, length(h || p)), 'allow') AS verdict
FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""

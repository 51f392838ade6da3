import random
import re

from tessera.llm.url_filter import RULES, judge_pages, rules_frame, url_filter

EXTRA = "rule string, verdict string, host string, path string"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "x", "x", "x", "x") for k, u in enumerate(urls)], "page_id long, url string, " + EXTRA)


def test_against_every_rule(spark):
    r = random.Random(3)
    urls = [None, "", "no scheme", "http://", "://example.com/en/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.net", "http://net/fr/", "http://xnet/fr/", "ftp://b.net/fr", "x://y://z.net/es/", "http://example.com/en/" + "a/" * 20000]
    urls += [f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'a.b.', 'www.www.'])}{r.choice(['example', 'ex', 'é'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr', 'EN', ''])}{r.choice(['', '/', '/1', '?q', '#f/en/'])}" for _ in range(600)]
    got = judge_pages(pages(spark, urls), rules_frame(spark, RULES)).collect()
    assert {tuple(r) for r in got} == {(k, *brute(u, RULES)) for k, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_many_rules_with_a_dense_filter(spark):
    rules = [(f"h{k}.com", f"/{'abc'[k % 3]}", "block") for k in range(500)]
    urls = [f"http://x.h{k}.com/{c}d" for k in range(0, 1000, 3) for c in "ac"]
    got = judge_pages(pages(spark, urls), rules_frame(spark, rules)).collect()
    dense = url_filter(pages(spark, urls), rules_frame(spark, rules), bits_per_key=1)
    assert {tuple(r) for r in got} == {(k, *brute(u, rules)) for k, u in enumerate(urls)}
    assert {tuple(r)[:4] for r in dense.collect()} == {brute(u, rules) for u in urls} and sum(r.n for r in dense.collect()) == len(urls)


def test_repeated_and_null_rows(spark):
    rows = [(None, "http://a.com/", "x"), (None, None, "x"), (1, "http://example.com/en/", "x"), (1, "http://example.com/en/", "x"), (2, None, "x"), (2, "http://b.net/fr/" + "y" * 100_000, "x")]
    got = judge_pages(spark.createDataFrame(rows, "page_id long, `u.rl` string, host string"), rules_frame(spark, RULES), url_col="u.rl").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute(u, RULES)) for i, u, _ in rows], key=str)


def test_no_rules_and_no_pages(spark):
    assert [tuple(r) for r in judge_pages(pages(spark, ["http://a.com/"]), rules_frame(spark, [])).collect()] == [(0, "a.com", "/", None, "allow")]
    assert judge_pages(pages(spark, []), rules_frame(spark, RULES)).count() == 0

import hashlib
from collections import defaultdict

from tessera.llm.common import clear, scratch_scope
from tessera.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(documents, odd):
    got = exact_dedup(documents(odd), all_hashes=True, slots=64).collect()
    assert sorted(map(tuple, got), key=str) == brute(odd)


def test_equal_lengths_and_prefixes_are_told_apart(documents):
    head = "p" * 80
    rows = [(k, head + "abcd"[k % 4]) for k in range(40)] + [(100, "q" * 81), (101, head[:64] + "z" * 17)]
    got = exact_dedup(documents(rows)).collect()
    assert {r.doc_id for r in got if r.kept} == {36, 37, 38, 39, 100, 101}
    assert all(r.text_sha256 is None for r in got if r.doc_id == 100)  # its content was never read in full


def test_scratch_is_cleared(spark, documents):
    with scratch_scope() as paths:
        got = exact_dedup(documents([(1, "a"), (2, "a")]))
        assert got.count() == 2
    assert len(paths) >= 2 and all(spark.read.parquet(p).count() == 2 for p in paths)
    clear(spark, paths)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    assert not any(hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p)) for p in paths)


def test_empty(documents):
    assert exact_dedup(documents([])).count() == 0

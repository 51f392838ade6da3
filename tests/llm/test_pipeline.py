import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import queries
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_pii import brute as pii_brute

WORDS = {"en": "the of and that with from there thing would house", "de": "der die und nicht eine schule für über auch haus", "fr": "le les des une avec être où français mais maison"}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for k in range(160):
        lang = r.choice(list(WORDS))
        text = [r.choice(WORDS[lang].split()) + r.choice(["", "s", "er", "on"]) for _ in range(r.randint(20, 120))]
        out.append((k, " ".join(text), lang))
        if k % 8 == 0:
            out.append((200 + k, " ".join(text), lang))
        if k % 10 == 0:
            out.append((400 + k, " ".join([*text[:-1], "changed"]), lang))
        if k % 20 == 0:
            out.append((600 + k, f"{k}!! ?", lang))
    out += [(900, "write the house of that to me@example.com and that from the would 1.2.3.4", "en"), (901, None, "en"), (902, "", None)]
    return out


def test_stages_follow_each_other(spark, documents, rows):
    docs, text = documents(rows), {i: t for i, t, _ in rows}
    kept = set(text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == out.count()
        if name == "language_id":
            none = {i for i in kept if not any(c.isalpha() for c in text[i] or "")}
            assert not none & set(got) and len(kept - none - set(got)) <= 0.02 * len(kept)
        elif name == "exact_dedup":
            last = {}
            for i in sorted(kept):
                last[text[i]] = i
            assert set(got) == set(last.values())
        elif name == "near_dedup":
            classes = near_brute([(i, text[i]) for i in sorted(kept)])
            assert len(got) == len(set(classes.values())) and {classes[i] for i in got} == set(classes.values())  # one of each class
        else:
            assert set(got) == kept
            for i, r in got.items():
                assert (r.text == text[i]) == (not pii_brute(text[i])) and r.n_chars == len(r.text)
        kept = set(got)
        text = {i: r.text for i, r in got.items()}
        docs = spark.createDataFrame([tuple(r) for r in got.values()], docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    assert {r.doc_id for r in packed} == kept and "[EMAIL]" in text[900] and "[IP]" in text[900]


def test_odd_and_empty_documents(spark, documents, odd, tmp_path):
    for k, rows in enumerate([odd, []]):
        documents([(*r, "en") for r in rows]).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert len(got) == 0 if not rows else all(r.length <= 1024 for r in got)
        if rows:  # what has letters and is no copy is packed in full
            assert {r.doc_id for r in got} == {None, 6, 7, 8, 10, 2**62} and len(got) == 5 + -(-60_001 // 1024)


def test_dedup_stages_decide_on_rows(spark, documents):
    """Repeated and null ids: no unique text is lost, and exactly one row of each group stays."""
    long = "quite another text of some more words than five for the signature to be of use here and there"
    rows = [(7, "a"), (9, "a"), (7, "unique text"), (None, "n"), (None, "n"), (None, "a"), (3, "same row"), (3, "same row"), (None, None), (4, ""), (None, "lone")]
    got = corpus_pipeline.drop_exact(spark, documents(rows), None)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(9, "a"), (7, "unique text"), (None, "n"), (3, "same row"), (4, ""), (None, "lone")], key=str)
    rows = [(7, long), (9, f"{long} too"), (9, "unique text of nine"), (None, f"{long} also"), (3, "same row"), (3, "same row"), (None, "lone one"), (8, long)]
    docs = documents(rows)
    docs = docs.withColumn("a.b", docs["word"])
    got = corpus_pipeline.drop_near(spark, docs, None)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sum(t.startswith(long) for _, t in kept) == 1
    assert sorted(((i, t) for i, t in kept if not t.startswith(long)), key=str) == sorted([(9, "unique text of nine"), (3, "same row"), (None, "lone one")], key=str)


def test_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "best_fit_packing"]


def test_n_chars_is_a_long(spark, documents):
    out = corpus_pipeline.mask_pii(spark, documents([(1, "a@b.co")]), None)
    assert dict(out.dtypes)["n_chars"] == "bigint" and np.array_equal([r.text for r in out.collect()], ["[EMAIL]"])

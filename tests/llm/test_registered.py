"""What is registered, as it is registered: each query over whole tables, against its SQL or a plain Python form."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from tessera.llm import language_id, queries
from tessera.llm.html_extract import main_texts, trained
from tessera.llm.packing import encode, pieces_of
from tessera.llm.sentencepiece_codec import model_path
from tessera.sources.tables import NAMES
from tests.llm.test_pii import brute

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda data: sorted(map(tuple, data), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_op2(spark, texts):
    first = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = {r.doc_id: r for r in queries.QUERIES["op2_sentencepiece"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        ids = first.encode(text)
        assert (got[k].n_ids, got[k].ids_crc32, got[k].parity) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert got[k].decoded_crc32 == zlib.crc32(first.decode(ids).encode())


def test_op3(spark, texts):
    """Each subword's bucket and the mean of their weights by a plain loop."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    whole = (1 << 64) - 1
    for k, text in sorted(texts.items())[:60]:
        text = " " + " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text[:3000] if len(text) <= 3000).split()) + " "
        if len(text) < 4:
            continue
        sums, n = np.zeros(len(model.languages)), 0
        for size in language_id.GRAMS:
            for at in range(len(text) - size + 1):
                gram = text[at : at + size]
                if gram.strip() and " " not in gram[1:-1] and not (size == 1 and gram == " "):
                    h = 0
                    for c in gram:
                        h = (h * language_id.BASE + ord(c) + 1) & whole
                    sums += model.table[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & whole) >> 48]
                    n += 1
        p = language_id.softmax((sums / n + model.bias)[None] / model.temperature)[0]
        assert got[k].lang_pred == model.languages[p.argmax()] and abs(got[k].score - p.max()) < 1e-4 and got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_op5(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op5_pii"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        base = brute(text)
        joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[k].spans.startswith(joined)
        assert [got[k][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [sum(x == kind for x, *_ in base) for kind in ("email", "ip", "card", "phone")]


def test_op6(spark, texts):
    got, bins = {}, {}
    for r in queries.QUERIES["op6_best_fit_packing"](spark, SMALL).collect():
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for k, text in texts.items():
        ids = np.append(encode(text), np.array([2], "<u4"))
        want |= {(k, p): (s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, s, n in pieces_of(len(ids))}
    assert got == want
    for items in bins.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [a for a, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_op10(spark, duck):
    pages = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    got = {r.page_id: tuple(r) for r in queries.QUERIES["op10_html_extract"](spark, SMALL).collect()}
    want = main_texts([h for *_, h in pages], trained())
    assert got == {i: (i, u, t, len(t)) for (i, u, _), t in zip(pages, want, strict=True)}

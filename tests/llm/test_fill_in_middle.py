import hashlib
import random
import re

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera.llm.fill_in_middle import fill_in_middle, restore


def plain(key, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text or ""
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    assert x + y + z == text
    return len(units), *(("spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < spm else ("psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"))


LINES = ["a\n", "\n", "bc", "é日😀\r\n", "x < y > z\n", "<P", "S>", "<\n", "   ok\n"]


def test_against_a_plain_form_and_back(spark, documents, odd):
    r = random.Random(1)
    rows = [*odd, *[(k, "".join(r.choices(LINES, k=r.randint(0, 9)))) for k in range(100, 400)], (500, "has <S> inside\nit"), (501, "line of text\n" * 40_000), (502, "\n" * 50_000), (502, "one")]
    docs = documents(rows).withColumn("fim", F.lit("clash"))
    out = fill_in_middle(docs, digests=True)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", tuple(r.fim)) for r in out.collect())
    want = []
    for i, text in rows:
        facts = plain(i, text)
        want.append((i or 0, text or "", (*facts, *[hashlib.sha256(x.encode()).hexdigest() for x in (facts[-1], text or "")])))
    assert got == sorted(want) and {x[2][1] for x in got} == {"plain", "psm", "spm"}
    back = restore(out.withColumnRenamed("text", "given"), out_col="text")
    assert back.where("text <> coalesce(given, '')").count() == 0


def test_rates_units_and_marks(spark, documents):
    docs = documents([(k, f"one two {k} three four five") for k in range(200)])
    forms = [r.fim.form for r in fill_in_middle(docs, rate=50, spm=0).collect()]
    assert set(forms) == {"plain", "psm"} and forms == [plain(k, "x", rate=50, spm=0)[1] for k in range(200)]
    words = fill_in_middle(docs, unit=r"\s*\S+", marks=("e", "t", "w"))  # marks that texts hold: all stay plain
    assert {(r.fim.n, r.fim.form) for r in words.collect()} == {(6, "plain")}
    assert {(r.fim.n, r.fim.form) for r in fill_in_middle(docs, unit=r"\s*\S+").collect()} == {(6, "psm"), (6, "spm")}
    seams = fill_in_middle(documents([(k, "-a-\n-b-\n-") for k in range(50)]), marks=("--", "->", "-<"))  # a mark may arise at a seam: then the text stays plain
    assert restore(seams, out_col="back", marks=("--", "->", "-<")).where("back <> text").count() == 0


def test_empty_table_null_and_wrong_outputs(spark, documents):
    assert fill_in_middle(documents([])).count() == 0
    df = spark.sql("SELECT struct('psm' AS form, cast(null AS string) AS output) AS fim")
    assert restore(df).first().text is None
    with pytest.raises(PythonException):
        restore(spark.sql("SELECT struct('psm' AS form, 'no marks' AS output) AS fim")).collect()

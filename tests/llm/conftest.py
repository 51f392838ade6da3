import pytest

#: Columns that operators might use themselves.
EXTRA = ["word", "mask", "slot", "kept", "key", "class", "row", "gone_id", "lang_id", "block", "cell", "len", "n"]


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text[, lang]) rows with columns whose names clash."""

    def make(rows):
        full = [(*r, *[None] * (3 - len(r)), "src", None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
        return spark.createDataFrame(full, schema)

    return make


#: Null and empty texts, null ids, ties, repeated rows, a very long text, text without letters or with odd characters.
ODD = [(1, None), (2, ""), (3, ""), (None, "alone"), (None, None), (5, "same words here for all of us"), (6, "same words here for all of us"), (7, "repeated row"), (7, "repeated row"), (8, "lang " * 60_000), (9, "12 34 !!"), (10, "é日本語 😀 \x00 \u2028 ok"), (-4, " \n\t "), (2**62, "large id")]


@pytest.fixture
def odd():
    return list(ODD)

"""Fill-in-the-middle: whole texts cut at unit boundaries and put in another order, exactly and repeatably."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, lower_batches

#: Units that a text is cut between: lines with their line feed.
LINE = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def cut(text: str, key: str, *, unit: regex.Pattern, seed: int, rate: int, spm: int, marks: Sequence[str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix, of middle, output) of one text; the last three but the output are none for ``plain``.

    Four numbers of the SHA-256 of seed and key decide: the first two where the middle begins and ends, in units, the
    third whether the text is transformed, the fourth in which order.
    """
    ends = array("q", (m.end() for m in unit.finditer(text)))  # 8 bytes a unit, whatever the text's length
    n, digest = len(ends), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if text and h3 % 100 < rate and not any(m in text for m in marks):
        a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        form, output = ("spm", f"{marks[1]}{text[b:]}{marks[0]}{text[:a]}{marks[2]}{text[a:b]}") if h4 % 100 < spm else ("psm", f"{marks[0]}{text[:a]}{marks[1]}{text[b:]}{marks[2]}{text[a:b]}")
        if _rebuilt(output, form, marks) == text:  # always so, but for marks of which one can arise at a seam
            return n, form, a, b - a, output
    return n, "plain", None, None, text


def _rebuilt(output: str, form: str, marks: Sequence[str]) -> str:
    if form == "plain":
        return output
    if form not in ("psm", "spm"):
        raise ValueError(f"no such form: {form}")
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, found, rest = output[len(first) :].partition(second)
    other, found_too, middle = rest.partition(m)
    if not (output.startswith(first) and found and found_too):
        raise ValueError(f"not an output of form {form}")
    return one + middle + other if form == "psm" else other + middle + one


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", unit: str = LINE, seed: int = 7, rate: int = 100, spm: int = 50, marks: Sequence[str] = MARKS, texts: bool = True, digests: bool = False
) -> DataFrame:
    """``docs`` with a column ``out_col``, in place of one of that name: struct of n (units), form (plain, psm or spm), prefix_chars, middle_chars, and
    output (if ``texts``), output_sha256 and restored_sha256 (if ``digests``), the hash of the text rebuilt from output and form alone.

    ``unit`` is a pattern of the regex library, ``rate`` and ``spm`` are percentages of texts that are transformed and, of these, begin with the
    suffix. A text that holds a mark stays plain, as do empty ones; null text counts as empty. The draw depends on the id only, so
    repeated ids are cut by the same numbers, a null id like an empty one, and a task that runs again gives the same. Whole texts are cut, in characters
    (code points); a very long text is one row of one task, which holds it, its output and 8 bytes a unit. There is no shuffle; an empty table gives
    an empty result; other columns pass through unread.
    """
    lower_batches(docs.sparkSession)
    kinds = ["n long", "form string", "prefix_chars long", "middle_chars long"] + ["output string"] * texts + ["output_sha256 string", "restored_sha256 string"] * digests
    names = [x.split()[0] for x in kinds]

    @F.pandas_udf(", ".join(kinds))
    def run(keys: pd.Series, values: pd.Series) -> pd.DataFrame:
        pattern, out = regex.compile(unit), []
        for key, text in zip(keys, values, strict=True):
            n, form, before, middle, output = cut(text or "", key or "", unit=pattern, seed=seed, rate=rate, spm=spm, marks=marks)
            row = [n, form, before, middle]
            if texts:
                row.append(output)
            if digests:
                row += [hashlib.sha256(x.encode()).hexdigest() for x in (output, _rebuilt(output, form, marks))]
            out.append(row)
        return pd.DataFrame(out, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(out_col, run(col(id_col).cast("string"), col(text_col)))


def restore(docs: DataFrame, *, fim_col: str = "fim", out_col: str = "text", marks: Sequence[str] = MARKS) -> DataFrame:
    """``docs`` with the texts that ``fill_in_middle`` was given, from form and output in ``fim_col``; a null output gives null. An output that
    its form can't have made raises."""
    lower_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _rebuilt(x, form, marks) for x, form in zip(outputs, forms, strict=True)], dtype=object)

    fim = col(fim_col)
    return docs.withColumn(out_col, run(fim["output"], fim["form"]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs, texts=False, digests=True).select("doc_id", "fim.*")


#: The text's parts between line feeds give the lines; ``head`` is the text up to the end of so many lines.
OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM n),
head AS (SELECT *, CASE WHEN low = 0 THEN '' WHEN low = len(parts) THEN text ELSE array_to_string(parts[1:low], chr(10)) || chr(10) END AS a, CASE WHEN high = 0 THEN '' WHEN high = len(parts) THEN text ELSE array_to_string(parts[1:high], chr(10)) || chr(10) END AS b FROM k),
cut AS (SELECT *, substr(text, length(a) + 1, length(b) - length(a)) AS middle, substr(text, length(b) + 1) AS suffix, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM head)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || a || '<M>' || middle END) AS output_sha256,
 sha256(a || middle || suffix) AS restored_sha256
FROM cut
"""

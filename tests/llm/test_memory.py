"""What the pipeline's stages leave in an executor's Python workers."""

import subprocess
import sys

import pytest

from tessera.llm import packing

GROWS = """
import re
from tessera.sources.workers import frugal

def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(batches):
    for n in batches:
        held = [bytes(1000) for _ in range(n)]
        pinned.append(held[-1])  # what stays lies behind all that goes
        yield len(held)

pinned = []
before = mb()
assert list(wrapped(iter([150_000]))) == [150_000]
print(mb() - before)
"""


@pytest.mark.parametrize("wrapped, stays", [("run", True), ("frugal(run)", False)])
def test_a_task_gives_its_memory_back(wrapped, stays):
    out = subprocess.run([sys.executable, "-c", GROWS.replace("wrapped(", f"{wrapped}(")], capture_output=True, text=True, check=True)
    assert (float(out.stdout) > 100) == stays


def test_packing_takes_no_other_kind_of_workers(spark, documents, monkeypatch):
    """Rows of Python objects would go to the JVM through workers that nothing else uses."""

    def refuse(*_):
        raise AssertionError("rows of Python objects")

    docs = documents([(1, "a b c"), (2, None), (3, "word " * 3000)])
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and sum(r.length for r in got) > 3000


def test_ordinary_texts_load_one_vocabulary():
    packing._exact.cache_clear()
    plain = packing.encode("ordinary words, 12 numbers and é")
    assert packing._exact.cache_info().currsize == 0
    special = packing.encode("words <|endoftext|>")
    assert packing._exact.cache_info().currsize == 1 and len(plain) and len(special)

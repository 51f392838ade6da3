import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
import sentencepiece

from tessera.llm.sentencepiece_codec import MARK, PROBES, Codec, _threads, codec, decode_column, encode_column, model_path, parse, rebuild, round_trip


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("ab e▁ \n\t1<s>ßé日😀x.,' the ") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_parity_and_round_trip():
    made = codec(model_path())
    first = sentencepiece.SentencePieceProcessor(model_file=model_path())
    some = [*PROBES, *texts(2000), "long " * 20_000, "x" * 20_000]
    ids = made.encode(some)
    assert ids == first.encode(some) and made.decode(ids) == first.decode(ids)
    assert all(made.encode([t]) == [x] for t, x in zip(some[:500], ids, strict=False))  # with the faster path where it may be taken
    odd = [[k] for k in range(300)] + [[3 + 0xE6, 3 + 0x97], [0], [1, 300, 2], [3 + 0xFF] * 3, [259, 259], [], [1, 259, 0, 300], [3 + 32, 300], [300, 0, 0], [3 + 0xE6, 300, 3 + 0x97, 3 + 0xA5]]
    mark = [3 + x for x in MARK.encode()]
    odd += [mark, [300, *mark, 301], [*mark, 259, 300], [300, *mark[:2], 301, *mark[2:]]]
    r = random.Random(5)
    odd += [[r.choice([0, 1, 2, *range(3, 259), *range(259, 600)]) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    assert [x for x in odd if made.decode([x]) != [first.decode(x)]] == []
    plain = [t for t in some if "▁" not in t]
    assert made.decode(made.encode(plain)) == plain


def field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(**spec):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    words = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "▁the", "t", "h", "e", "he", "x"]
    pieces += [(w, -1.0 - 0.37 * k - len(w) / 9, 1) for k, w in enumerate(words)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    return data + field(2, field(3, 1) + field(4, len(pieces))) + field(3, field(1, b"identity") + field(3, spec.get("dummy", 1)) + field(4, spec.get("strip", 1)) + field(5, 1))


@pytest.mark.parametrize("strip", [0, 1])
@pytest.mark.parametrize("dummy", [0, 1])
def test_unigram_models(tmp_path, strip, dummy):
    path = tmp_path / "m.model"
    path.write_bytes(unigram(strip=strip, dummy=dummy))
    made = Codec(str(path))
    r = random.Random(7)
    some = ["".join(r.choice("aabbthe x") for _ in range(r.randint(0, 25))) for _ in range(500)]
    first = sentencepiece.SentencePieceProcessor(model_proto=path.read_bytes())
    assert made.encode(some) == first.encode(some)
    assert made.model.strip_spaces == bool(strip) and made.model.dummy_prefix == bool(dummy)


def test_unigram_decoding(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(unigram(strip=0))
    made, first, r = Codec(str(path)), sentencepiece.SentencePieceProcessor(model_proto=unigram(strip=0)), random.Random(8)
    some = [[r.randrange(17) for _ in range(r.randint(0, 9))] for _ in range(1000)]
    assert [x for x in some if made.decode([x]) != [first.decode(x)]] == []


def test_threads(monkeypatch):
    monkeypatch.delenv("RAYON_NUM_THREADS", raising=False)
    _threads()
    assert int(os.environ["RAYON_NUM_THREADS"]) > 1
    code = "from tests.llm.test_sentencepiece import *; import threading; made = codec(model_path()); some = texts(5000, 3) * 4; got = made.encode(some); first = sentencepiece.SentencePieceProcessor(model_file=model_path()); print(got == first.encode(some), made.decode(got) == first.decode(got), len(os.listdir('/proc/self/task')) > threading.active_count())"
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"RAYON_NUM_THREADS": "4"}, capture_output=True, text=True, timeout=300)
    assert run.stdout.split() == ["True"] * 3, run.stderr[-500:]


def test_what_cannot_be_rebuilt_raises():
    data = unigram() + field(1, field(1, b"zz") + field(2, 0.0) + field(3, 4))
    with pytest.raises(ValueError):
        rebuild(parse(data))


def test_columns(documents, odd):
    rows = round_trip(documents(odd)).collect()
    first = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = []
    for i, t in odd:
        ids = first.encode(t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32((t or "").encode()), True, True))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    back = decode_column(encode_column(documents(odd).select("doc_id", "text")), out_col="back").collect()
    assert all(r.text == r.back for r in back) and len(back) == len(odd)
    assert round_trip(documents([])).count() == 0


def test_columns_of_the_outputs_names_stay(documents):
    got = encode_column(documents([(1, "some words", "en")]).selectExpr("doc_id", "text", "'own' AS ids")).first()
    assert got["ids"] == "own" and got["_ids"] == codec(model_path()).encode(["some words"])[0]
    back = decode_column(documents([(1, "some words", "en")]).selectExpr("'own' AS text", "array(1, 2) AS ids")).first()
    assert back["text"] == "own" and back["_text"] == codec(model_path()).decode([[1, 2]])[0]


def test_each_word_is_encoded_once():
    """A word that comes again in a batch costs the library nothing."""
    made, first, seen = Codec(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path()), []

    class Counting:
        def __init__(self, core):
            self.core = core

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.core.encode_batch_fast(texts, **more)

    made.plain.core = Counting(made.plain.core)
    r = random.Random(6)
    some = [" ".join(r.choice(["alpha", "beta", "é日", "x\ny", "😀", "<s>", "tab\t", "a" * 50]) for _ in range(50)) + r.choice(["", " ", "."]) for _ in range(200)]
    some += ["", "a  b", f"{MARK}c", " d", "e "]
    assert made.encode(some) == first.encode(some) and sum(map(len, seen)) < 500 < sum(map(len, some))
    some = [" ".join(f"w{r.randrange(9000)}" for _ in range(3000)) for _ in range(9)]
    assert made.encode(some) == first.encode(some)

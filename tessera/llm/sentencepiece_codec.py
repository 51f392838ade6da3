"""SentencePiece encoding and decoding on the Tokenizers library: the model file is parsed and rebuilt, with checked parity."""

from __future__ import annotations

import array
import functools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, lower_batches
from .text import slices

#: The whitespace marker.
MARK = "▁"
#: Words whose ids the library keeps. On text with many rare words its cache costs more than it saves.
CACHE = 1000
#: Piece types in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts that every rebuilt tokenizer must encode and decode as the original does.
PROBES = ("", " ", "  a  b ", "\n x\t\r\n", f"{MARK}x{MARK}{MARK} y", "日本語 😀 ﬁ Å é é", "<s> </s> <unk> <0x41>", "\x00\x7f�", "a b　c", "x" * 300, "    def f(x):\n        return 'ü'  ", "1234567890 3.14", "ＡＢＣ １２３", "​zero‍width")


@dataclass
class Model:
    """What of the model file decides ids."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True
    space_as_suffix: bool = False
    unk: int = 0
    unk_surface: str = " \u2047 "


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields: integers, or bytes for the other wire types."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if key & 7 == 2:
                size, at = _varint(data, at)
            if size is None:
                raise ValueError(f"wire type {key & 7} in the model file")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """The model of a SentencePiece file: pieces (field 1), trainer spec (2), normalizer spec (3)."""
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback, model.space_as_suffix = spec.get(3, 1), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            model.unk_surface = spec[44].decode() if 44 in spec else model.unk_surface
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.strip_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    model.unk = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model, which its file leaves to the scores: each split of a piece into two pieces, best piece first."""
    usable = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    found = []
    for piece, score in usable.items():
        for k in range(1, len(piece)):
            if piece[:k] in usable and piece[k:] in usable:
                found.append((-score, piece[:k], piece[k:]))
    return [(a, b) for _, a, b in sorted(found, key=lambda x: x[0])]


def rebuild(model: Model, cache: int = CACHE):
    """A ``tokenizers.Tokenizer`` with the model's normaliser, marker, scores or merges, and byte fallback.

    Raises for features that the library can't express: markers as suffixes, unescaped
    spaces, user-defined or unused pieces, and kinds other than unigram and BPE.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    odd = {kind for *_, kind in model.pieces} & {USER, UNUSED}
    if odd or model.space_as_suffix or not model.escape_spaces or model.kind not in (1, 2):
        raise ValueError(f"not supported: piece types {sorted(odd)}, suffix {model.space_as_suffix}, escaped {model.escape_spaces}, kind {model.kind}")
    usable = [p for p, _, kind in model.pieces if kind == NORMAL]
    if model.kind == 1:
        core = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback))
    else:
        vocab = {p: k for k, (p, *_) in enumerate(model.pieces)}
        core = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=cache))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    core.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p in usable):  # no piece goes on behind a word: words can be encoded (and kept) one by one
        core.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    core.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return core


def plain(model: Model):
    """A faster ``tokenizers.Tokenizer`` for texts with single spaces, none of them first, and no markers: None if the model rules it out.

    It marks and splits words in one step, without a regular expression, and keeps no words' ids: ``Words`` does.
    """
    from tokenizers import normalizers, pre_tokenizers

    if model.charsmap or model.strip_spaces or not model.dummy_prefix or any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL):
        return None
    core = rebuild(model, 0)
    core.normalizer = normalizers.Sequence([])
    core.pre_tokenizer = pre_tokenizers.Metaspace(MARK, prepend_scheme="always", split=True)
    return core


def joined(model: Model):
    """A faster ``tokenizers.Tokenizer`` to decode with: it only joins pieces, so that markers are still to be replaced, once for the whole text."""
    from tokenizers import Tokenizer, decoders, models

    core = Tokenizer(models.WordLevel({p: k for k, (p, *_) in enumerate(model.pieces)}, model.pieces[model.unk][0]))
    core.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return core


#: Marks of pieces in ``Codec.marked``.
_HIDDEN, _UNKNOWN, _SPELLED = 1, 2, 4
#: Characters that one call of the libraries gets, or one text.
CALL = 1 << 20
#: Characters among which words are encoded once.
BATCH = 1 << 22


def packed(ids: list[int]) -> np.ndarray:
    """Ids as unsigned 32-bit integers; by ``array``, which reads a list of integers three times as fast as numpy."""
    return np.frombuffer(array.array("I", ids), np.uint32)


class Words:
    """Encodes texts for ``plain``: the library encodes each different word of a batch once, and a text's ids are those of its words.

    No piece goes on behind a word, so a word has the same ids wherever it stands.
    """

    def __init__(self, core, model: Model):
        self.core = core
        self.begins = np.array([p[:1] == MARK for p, *_ in model.pieces], bool)
        one, two = [packed(e.ids) for e in core.encode_batch_fast(["x", "x "], add_special_tokens=False)]
        self.blank = two[len(one) :]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, none of them empty."""
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = words.values.dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if (at := pc.index(names, "").as_py()) >= 0:  # behind a space at a text's end; goes last
            codes = np.where(codes == at, len(names) - 1, codes - (codes > at))
            names = names.filter(pc.not_equal(names, ""))
        ids, sizes = self._new(names)
        ids, sizes = np.concatenate([ids, self.blank]), np.append(sizes, len(self.blank))
        first, size = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        flat = ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return np.split(flat, np.cumsum(size)[words.offsets.to_numpy()[1:-1] - 1])

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words that are not empty: joined to a few texts, in which pieces with a marker begin words."""
        parts = pa.ListArray.from_arrays(pa.array([*range(0, len(words), 4096), len(words)], pa.int32()), words)
        ids = [packed(e.ids) for e in self.core.encode_batch_fast(pc.binary_join(parts, " ").to_pylist(), add_special_tokens=False)]
        flat = np.concatenate(ids)
        starts = np.flatnonzero(self.begins[flat])
        if len(starts) == len(words) and all(self.begins[x[0]] for x in ids):
            return flat, np.diff(np.append(starts, len(flat)))
        each = [packed(e.ids) for e in self.core.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]  # the model has no marker of its own
        return np.concatenate(each), np.array([len(x) for x in each])


class Codec:
    """Encodes and decodes as the model file says; ``verify`` compares with the SentencePiece library."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.model = parse(self.data)
        self.core = rebuild(self.model)
        fast = plain(self.model)
        self.plain = fast and Words(fast, self.model)
        self.joined = joined(self.model)
        self.hidden = {k for k, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        #: The byte piece that begins a marker spelled in bytes, which stays a marker.
        self.first_of_mark = next((k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE and int(p[3:5], 16) == MARK.encode()[0]), -1)
        #: Pieces that need more than the library's joining.
        self.marked = np.zeros(len(self.model.pieces), np.uint8)
        self.marked[list(self.hidden)] |= _HIDDEN
        self.marked[self.model.unk : self.model.unk + 1] |= _UNKNOWN
        if self.first_of_mark >= 0:
            self.marked[self.first_of_mark] |= _SPELLED
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [x.tolist() for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; the library encodes on its threads, however many the process allows it. Texts of over CALL characters, and such as ``plain`` is not made for, are encoded whole."""
        by_words = [self.plain is not None and 0 < len(t) <= CALL and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        fast, rest = [t for t, f in zip(texts, by_words, strict=True) if f], [t for t, f in zip(texts, by_words, strict=True) if not f]
        a = (x for part in slices(fast, BATCH) for x in self.plain.encode(fast[part]))
        b = (packed(e.ids) for part in slices(rest, CALL) for e in self.core.encode_batch_fast(rest[part], add_special_tokens=False))
        return [next(a if f else b) for f in by_words]

    def decode(self, ids: list[list[int]], packed_ids: list[np.ndarray] | None = None) -> list[str]:
        """Texts of ids (``packed_ids``: the same as arrays, if at hand) by the library, on its threads. It shows unknown pieces, broken UTF-8 and a first byte piece for a space in another way
        than the original: such texts are decoded by their bytes."""
        found = [int(np.bitwise_or.reduce(self.marked[x])) if len(x) else 0 for x in packed_ids or map(packed, ids)]
        hidden = [[k for k in x if k not in self.hidden] if f & _HIDDEN else x for x, f in zip(ids, found, strict=True)]
        out = [self._spaced(x) for x in self.joined.decode_batch(hidden, skip_special_tokens=False)]
        if spelled := [k for k, f in enumerate(found) if f & _SPELLED]:  # the library replaces markers piece by piece
            for k, text in zip(spelled, self.core.decode_batch([hidden[k] for k in spelled], skip_special_tokens=False), strict=True):
                out[k] = text
        return [self._by_bytes(x) if "\ufffd" in text or f & _UNKNOWN or x and self.bytes[x[0]] == b" " else text for x, text, f in zip(hidden, out, found, strict=True)]

    def _spaced(self, text: str) -> str:
        text = text.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def _by_bytes(self, ids: list[int]) -> str:
        data = b"".join(self.model.unk_surface.encode() if k == self.model.unk else self.bytes[k] for k in ids)
        if ids and self.model.dummy_prefix and self.model.pieces[ids[0]][0][:1] == MARK:
            data = data[1:]
        out, at = [], 0
        while at < len(data):  # each byte that begins no character is shown on its own
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode() + "\ufffd")
                at += e.start + 1
        return "".join(out)

    def verify(self, texts: list[str] | tuple[str, ...] = PROBES) -> list[str]:
        """The texts whose ids differ from the original library's, or whose ids decode to something else."""
        import sentencepiece

        first = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        texts = list(texts)
        ids = first.encode(texts, num_threads=1)
        return [t for t, a, b, c, d in zip(texts, ids, self.encode(texts), first.decode(ids), self.decode(ids), strict=True) if a != b or c != d]


@functools.cache
def codec(path: str) -> Codec:
    """The codec of a model file, once for each process, after PROBES show parity."""
    made = Codec(path)
    if wrong := made.verify():
        raise ValueError(f"{path}: the rebuilt tokenizer differs on {wrong}")
    return made


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Threads of the library in each Python worker: one encodes while the task hands rows over.
THREADS = 2


def _threads() -> None:
    """THREADS, or as many as the task has cores if that is more; what the worker's environment says counts first."""
    task = TaskContext.get()
    os.environ.setdefault("RAYON_NUM_THREADS", str(max(THREADS, task.cpus() if task else 1)))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")


def encode_column(docs: DataFrame, *, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with an array of ids for each text; null text gives null. ``path`` is the model file, on every worker. Where ``docs`` has a column ``out_col``, the new one gets underscores before its name. A very long text is one row, encoded whole; other columns pass through."""
    lower_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        _threads()
        ids = codec(path or model_path()).encode_packed(["" if x is None else x for x in texts])
        return pd.Series([None if t is None else x.astype(np.int32) for t, x in zip(texts, ids, strict=True)], dtype=object)

    return docs.withColumn(fresh(docs, out_col), run(col(text_col)))


def decode_column(docs: DataFrame, *, ids_col: str = "ids", out_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with the text of each array of ids; null ids give null, ids out of range raise. Where ``docs`` has a column ``out_col``, the new one gets underscores before its name."""
    lower_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        _threads()
        made = codec(path or model_path())
        return pd.Series([None if x is None else y for x, y in zip(ids, made.decode([[] if x is None else [int(k) for k in x] for x in ids]), strict=True)], dtype=object)

    return docs.withColumn(fresh(docs, out_col), run(col(ids_col)))


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, same, parity): what encoding and decoding each whole text gives.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids, ``decoded_crc32`` over the decoded text's UTF-8;
    ``same`` says that it is the text, ``parity`` that the original library gives the same
    ids. Null text counts as empty (no ids); null ids, repeated rows and other columns make no difference; a very long text is one row, encoded whole; an empty table
    gives an empty result.
    """
    lower_batches(docs.sparkSession)

    @F.pandas_udf("n_ids long, ids_crc32 long, decoded_crc32 long, same boolean, parity boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        import sentencepiece

        _threads()
        made, out = codec(path or model_path()), []
        first = _original(path or model_path(), sentencepiece)
        texts = texts.tolist()
        every = made.encode_packed(texts)
        for part in slices(texts, CALL):
            flat = every[part]
            ids = [x.tolist() for x in flat]
            for text, own, code, theirs, back in zip(texts[part], ids, flat, first.encode(texts[part], num_threads=1), made.decode(ids, flat), strict=True):
                out.append((len(own), zlib.crc32(code.astype("<u4", copy=False)), zlib.crc32(back.encode()), back == text, own == theirs))
        return pd.DataFrame(out, columns=["n_ids", "ids_crc32", "decoded_crc32", "same", "parity"])

    rows = docs.select(col(id_col).alias("doc_id"), run(F.coalesce(col(text_col), F.lit(""))).alias("r"))
    return rows.select("doc_id", "r.*")


@functools.cache
def _original(path: str, library):
    return library.SentencePieceProcessor(model_file=path)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

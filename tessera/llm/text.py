"""Texts as flat numpy arrays: folded code points, words and hashes, for whole batches at once."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: An odd multiplier modulo 2**64 and its inverse, for hashes of words by prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def slices(texts: Sequence[str], most_chars: int = 1 << 18) -> Iterator[slice]:
    """Slices of ``texts`` of at most ``most_chars`` characters, or of one text."""
    at, chars = 0, 0
    for k, text in enumerate(texts):
        if k > at and chars + len(text) > most_chars:
            yield slice(at, k)
            at, chars = k, 0
        chars += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


@functools.cache
def _folded(kind: str) -> np.ndarray:
    """For each code point its lower case if it is a letter (or, for kind ``word``, a letter, mark, digit or _), else a space."""
    inside = str.isalpha if kind == "letter" else lambda c: c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"
    return np.fromiter((ord(c.lower()[0]) if inside(c) else 32 for c in map(chr, range(0x110000))), np.uint32, 0x110000)


def folded(texts: Sequence[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): the texts folded, each with a space before it, and one space at the end; runs of spaces are one.

    bounds[k] is where text k begins (its space), bounds[-1] the place of the last space.
    """
    flat = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    flat = _folded(kind)[flat]
    space = flat == 32
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    place = np.cumsum(keep) - 1  # a dropped space falls on the one that is kept before it
    return flat[keep], place[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): 64-bit hashes of the lower-cased words of all texts in order; text k has hashes[bounds[k]:bounds[k+1]]."""
    flat, bounds = folded(texts, "word")
    spaces = np.flatnonzero(flat == 32)
    n = 1 << int(len(flat)).bit_length()
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed(flat.astype(np.uint64) + np.uint64(1)) * _powers(n, BASE)[: len(flat)], out=sums[1:])
    begin, end = spaces[:-1] + 1, spaces[1:]
    hashes = mixed((sums[end] - sums[begin]) * _powers(n, INVERSE)[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(spaces, bounds)  # the word after space k is word k


def shingles(texts: Sequence[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(text numbers, hashes, words): each run of ``size`` words, repeats included, ordered by text; shorter texts have one of all their words."""
    hashes, bounds = words(texts)
    count = np.diff(bounds)
    each = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), each)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    out = np.zeros(len(first), np.uint64)
    last = bounds[1:][owner]
    for k in range(size):
        at = first + k
        out = out * np.uint64(BASE) + np.where(at < last, hashes[np.minimum(at, max(len(hashes) - 1, 0))], np.uint64(0))
    return owner, mixed(out), (hashes, bounds)

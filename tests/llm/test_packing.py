import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import NODES, by_range, complete_bins, encode, fillings, intervals, lower_bound, pack, pieces_of


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_file(tokenizer):
    r = random.Random(1)
    texts = ["", " ", "a  b\n\n c", "x<|endoftext|>y", "日本 😀 it's 1234", "z" * 5000] + ["".join(r.choice("ab \n'.1é日<|>") for _ in range(r.randint(0, 80))) for _ in range(300)]
    for text in [*texts, " " * 1_000_000]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(got, rows, tokenizer, capacity=1024):
    ids = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in rows]
    want = sorted([(d, p, s, n, zlib.crc32(x[s : s + n].tobytes())) for d, x in ids for p, s, n in pieces_of(len(x), capacity)], key=str)
    assert sorted([tuple(r)[:5] for r in got], key=str) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_every_piece_has_a_place(documents, odd, tokenizer):
    r = random.Random(2)
    rows = odd + [(100 + k, " ".join(r.choice(["word", "xq", "the"]) for _ in range(int(r.expovariate(0.004))))) for k in range(150)]
    assert check(pack(documents(rows)).collect(), rows, tokenizer) > 10
    assert pack(documents([])).count() == 0


def exact(sizes, capacity):
    """Fewest bins by trying everything."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                bins[j] += sizes[k]
                go(k + 1, bins)
                bins[j] -= sizes[k]
        go(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_bin_completion_reaches_the_optimum_of_small_cases():
    r = random.Random(3)
    for _ in range(60):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 11))]
        bins = complete_bins(np.bincount(sizes, minlength=101), 100)
        used = sorted(s for items, n in bins for s in items * n)
        assert used == sorted(sizes) and all(sum(items) <= 100 for items, _ in bins)
        assert sum(n for _, n in bins) == exact(sizes, 100)


def test_repeated_sizes_reach_the_optimum():
    """Few different sizes, so that a filling must often be taken fewer times than it goes; up to 14 pieces."""
    r = random.Random(13)
    for _ in range(400):
        some = [r.randint(5, 70) for _ in range(r.randint(1, 6))]
        sizes = [r.choice(some) for _ in range(r.randint(1, 14))]
        bins = complete_bins(np.bincount(sizes, minlength=101), 100)
        assert sorted(s for items, n in bins for s in items * n) == sorted(sizes) and all(sum(items) <= 100 for items, _ in bins)
        assert sum(n for _, n in bins) == exact(sizes, 100), sizes
    sizes = [37, 23, 23, 40, 23, 25, 53, 53, 40, 25, 23, 53, 25, 40]
    assert sum(n for _, n in complete_bins(np.bincount(sizes, minlength=101), 100)) == 5


def test_lower_bound_is_one():
    r = random.Random(14)
    for _ in range(200):
        sizes = [r.randint(1, 100) for _ in range(r.randint(0, 9))]
        counts = np.bincount(sizes, minlength=101)
        assert -(-sum(sizes) // 100) <= lower_bound(counts, 100) <= exact(sizes, 100)


def test_near_the_bound_on_large_counts():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1, 100_000), 1, 1024).astype(int), minlength=1025)
    bins = complete_bins(counts)
    assert sum(n for _, n in bins) <= 1.002 * lower_bound(counts)
    places = intervals(bins)
    for size, rows in places.groupby("length"):
        rows = rows.sort_values("first")
        assert rows["first"].iloc[0] == 0 and (rows["first"].to_numpy()[1:] == rows["last"].to_numpy()[:-1] + 1).all() and rows["last"].iloc[-1] + 1 == counts[size]
    assert complete_bins(np.zeros(1025, int)) == []


def test_backtracking_has_steps_of_its_own(caplog):
    """So many lengths occur that the dives alone take over a thousand steps; what was searched and the gap are logged."""
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1, 100_000), 1, 1024).astype(int), minlength=1025)
    with caplog.at_level("INFO"):
        patterns = complete_bins(counts)
    report = caplog.records[-1].args
    assert report["bins"] == sum(n for _, n in patterns) == lower_bound(counts) + report["gap"]
    assert report["gap"] == 0 or report["branches"] > 0 and report["steps"] >= NODES
    used = np.zeros(1025, int)
    for items, n in patterns:
        np.add.at(used, items, n)
    assert (used == counts).all()


def test_fillings_are_undominated():
    counts = np.bincount([10, 20, 30, 40, 40], minlength=101)
    assert fillings(counts, 40, 100)[0] == [40]
    assert all(sum(f) <= 70 for f in fillings(counts, 70, 20)) and [40, 30] in fillings(counts, 70, 20)


def test_each_rank_meets_few_places():
    """A rank's range holds the place it belongs to, and places get at most twice as many rows however unequal they are."""
    rng = np.random.default_rng(4)
    for counts in (rng.integers(0, 60, 1025), np.where(np.arange(1025) % 37 == 5, 40_000, 0), np.bincount([7] * 1000 + [1024], minlength=1025), np.zeros(1025, int)):
        counts[0] = 0
        places = intervals(complete_bins(counts))
        cut, widths = by_range(places)
        assert len(cut) <= 2 * len(places) and sorted(widths["length"]) == sorted(set(places["length"]))
        width = dict(zip(widths["length"], widths["width"], strict=True))
        held = {}
        for r in cut.itertuples(index=False):
            held.setdefault((r.length, r.range), []).append((r.first, r.last))
        for length in np.flatnonzero(counts):
            for rank in {0, int(counts[length]) - 1, *map(int, rng.integers(0, counts[length], 20))}:
                assert sum(a <= rank <= b for a, b in held[length, rank // width[length]]) == 1

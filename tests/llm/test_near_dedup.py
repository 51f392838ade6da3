import random
import re
from collections import Counter

import numpy as np

from tessera.llm.common import components
from tessera.llm.near_dedup import against_first, bag, bag_minhash, near_dedup, overlaps
from tessera.llm.text import shingles

VOCABULARY = [f"w{k}" for k in range(400)]


def bags(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))


def alike(a, b):
    x, y = bags(a), bags(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(rows):
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            if alike(s, t) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in root}


def made(seed, groups):
    r = random.Random(seed)
    rows, common = [], " ".join(r.choice(VOCABULARY) for _ in range(60))
    for g in range(groups):
        base = [r.choice(VOCABULARY) for _ in range(r.randint(5, 200))]
        if g % 3 == 0:
            base += common.split() + base[:20]
        for _ in range(r.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(VOCABULARY)
            rows.append((len(rows), ", ".join(words).upper() if r.random() < 0.1 else " ".join(words)))
    return rows


def test_classes_against_all_pairs(documents):
    rows = made(4, 60)
    got = {r.doc_id: r.class_id for r in near_dedup(documents(rows)).collect()}
    assert got == brute(rows)


def test_a_chain_of_near_copies_is_one_class(documents):
    words, rows = [f"v{k}" for k in range(120)], []
    for k in range(60):
        words = [*words[1:], f"n{k}"]  # each overlaps its neighbours; far ones share little
        rows.append((k, " ".join(words)))
    got = near_dedup(documents(rows)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_odd_rows(documents, odd):
    got = near_dedup(documents(odd)).collect()
    assert len(got) == len(odd)
    of = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert of[5] == of[6] == 5 and of[1] == 1 and of[2] == 2 and of[9] == 9 and of[-4] == -4
    assert all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup(documents([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    r = random.Random(5)
    left, right = [], []
    for _ in range(40):
        a = [r.choice(VOCABULARY) for _ in range(150)] * r.choice([1, 2, 3]) + [r.choice(VOCABULARY)]
        b = list(a)
        for _ in range(r.randint(1, 20)):
            b[r.randrange(len(b))] = "x"
        left.append(" ".join(a))
        right.append(" ".join(b))
    true = np.array([alike(a, b) for a, b in zip(left, right, strict=True)])
    exact = overlaps([*left, *right], columns=64)
    assert np.abs(exact[np.arange(40), np.arange(40, 80)] - true).max() < 1e-12
    sig = [bag_minhash(*bag(*shingles(t)[:2]), len(t), 1024) for t in (left, right)]
    estimate = (sig[0] == sig[1]).mean(axis=1)
    assert abs((estimate - true).mean()) < 0.01 and np.abs(estimate - true).max() < 0.07
    alone = bag_minhash(*bag(*shingles(left[7:8])[:2]), 1, 1024)
    assert (alone[0] == sig[0][7]).all()  # a signature doesn't depend on its batch


def test_a_large_bucket_is_cut_into_blocks(documents):
    r = random.Random(8)
    base, rows = [r.choice(VOCABULARY) for _ in range(150)], []
    for k in range(600):
        words = list(base)
        words[r.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    got = near_dedup(documents(rows)).collect()
    assert {x.class_id for x in got} == {0}


def test_stars_alone_do_not_settle_a_class(documents):
    """A family of templates: far ones, near ones and links that avoid the best connected text."""
    r, rows = random.Random(12), []
    base = [r.choice(VOCABULARY) for _ in range(100)]
    for k in range(120):
        words = list(base)
        for at in r.sample(range(100), r.choice([1, 2, 3, 4, 5])):
            words[at] = f"y{r.randrange(60)}"
        rows.append((k, " ".join(words)))
    got = {x.doc_id: x.class_id for x in near_dedup(documents(rows)).collect()}
    assert got == brute(rows)


def test_against_first():
    texts = [t for _, t in made(7, 12)] + ["", "a " * 30, "a " * 28]
    for hub in (texts[0], "a " * 29, ""):
        assert np.abs(against_first([hub, *texts]) - [alike(hub, t) for t in [hub, *texts]]).max() < 1e-12


def test_a_row_repeated_a_thousand_times_is_compared_once(documents):
    r = random.Random(10)
    base = [r.choice(VOCABULARY) for _ in range(100)]
    near, other = " ".join([*base[:-1], "changed"]), " ".join(r.choice(VOCABULARY) for _ in range(100))
    rows = [(5, " ".join(base))] * 1000 + [(5, other), (6, near), (7, other)]
    got = near_dedup(documents(rows)).collect()
    assert len(got) == 1003 and {x.class_id for x in got} == {5}
    assert sum(x.kept for x in got) == 1001 and all(x.kept == (x.doc_id == 5) for x in got)


def test_overlaps_of_repeated_shingles():
    texts = ["a " * 50, "a " * 45, "a " * 30 + "b " * 30, "", "b a", "B, a", "c " * 7 + "a " * 44]
    got = overlaps(texts)
    want = [[alike(a, b) for b in texts] for a in texts]
    assert np.abs(got - want).max() < 1e-12


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7), (999, 999)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges + [(None, 5)], "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

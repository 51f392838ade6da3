import math
import random

import numpy as np
import pytest

from tessera.llm.toxicity import BUCKETS, Model, counted, descend, features, fit, held_out, learn, op11_toxicity, risk, score, threshold

BAD, GOOD = ["vileword", "nastily", "scumbag", "nastier"], ["house", "garden", "river", "stone", "window", "paper", "cloud", "bread"]


def made(n, seed=1, share=0.2):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words, toxic = [r.choice(GOOD) + r.choice(["", "s", "ly"]) for _ in range(r.randint(5, 60))], r.random() < share
        for _ in range(r.randint(1, 4) if toxic else 0):
            words.insert(r.randint(0, len(words)), r.choice(BAD))
        out.append((" ".join(words), int(toxic)))
    return out


def test_features_match_a_plain_loop():
    texts = ["Ab abc abcd", "", "longestwords longestworda é1_x", "..", "abcdefgh abcdefghi abc"]
    got = [set() for _ in texts]
    n = np.zeros(len(texts), int)
    for owner, bucket in features(texts):
        assert ((bucket >= 0) & (bucket < BUCKETS)).all()
        for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            got[o].add(b)
            n[o] += 1
    plain, times = [], []
    for t in texts:
        words = [w for w in "".join(c.lower() if c.isalnum() or c == "_" else " " for c in t).split()]
        every = [(w[:k], "beginning") for w in words for k in (3, 4, 5, 6, 7, 8) if len(w) >= k] + [(w, "whole") for w in words if len(w) > 1]
        plain.append(len(set(every)))
        times.append(len(every))
    assert [len(x) for x in got] == plain and n.tolist() == times
    assert len(got[0]) == 5 and len(got[0] & got[4]) == 3  # "abc" as a word and as a beginning, and the beginning "abcd"


def test_counts_do_not_depend_on_the_batch():
    texts = [t for t, _ in made(50)]
    kept = np.unique(np.concatenate([b for _, b in features(texts)]))[::2]
    whole = counted(texts, kept)
    assert np.array_equal(whole, np.concatenate([counted([t], kept) for t in texts]))
    assert np.allclose(np.expm1(whole[:, -1] * 10), [len(t.split()) for t in texts])


def test_risk_and_threshold_against_plain_loops():
    r = np.random.default_rng(1)
    p, u, prior = r.normal(1, 1, 20), r.normal(-1, 1, 30), 0.3
    loss = lambda z: math.log(1 + math.exp(-z))
    own, others = risk(p, u, prior)
    assert own == pytest.approx(prior * sum(loss(x) for x in p) / 20)
    assert others == pytest.approx(sum(loss(-x) for x in u) / 30 - prior * sum(loss(-x) for x in p) / 20)
    cost = lambda t: prior * np.mean(p < t) + max(0, np.mean(u >= t) - prior * np.mean(p >= t))
    at = [t for t in [0.0, *p, *u] if t <= 0]
    assert threshold(p, u, prior) == max(t for t in at if cost(t) <= min(map(cost, at)) + 1e-12)


def test_the_second_part_of_the_risk_stays_near_zero_or_above():
    """Random rows, more weights than rows: plain descent would drive the estimate far below zero."""
    r = np.random.default_rng(2)
    p, u = r.normal(0, 1, (40, 300)).astype(np.float32), r.normal(0, 1, (60, 300)).astype(np.float32)
    w, b = descend(p, u, 0.4, 0)
    assert risk(p @ w + b, u @ w + b, 0.4)[1] > -0.5


def test_held_out_rows():
    rows = made(1500)
    known, rest = rows[:1000], rows[1000:]
    positive, unlabelled = [t for t, y in known if y][:120], [t for t, _ in known]
    model = fit(positive, unlabelled, 0.2)
    y, s = np.array([y for _, y in rest]), model.scores([t for t, _ in rest])
    assert ((s >= 0) & (s <= 1)).all() and np.mean((s >= 0.5) == y) > 0.98
    assert model.scores(["nastily " * 3 + "house " * 50, "", "river " * 20_000])[0] > 0.5 > max(model.scores(["", "river " * 20_000]))
    again = fit(positive, unlabelled, 0.2)
    assert again.bias == model.bias and np.array_equal(again.weight, model.weight)


def test_nothing_to_learn_from(spark, documents):
    assert fit([], ["a"], 0.2).scores(["x", ""]).tolist() == pytest.approx([0.2, 0.2]) and fit(["a"], [], 0.2).scores(["a"])[0] == pytest.approx(0.2)
    few = fit(["bad words"], ["bad words", "good"], 0.5).scores(["bad", ""])
    assert ((few >= 0) & (few <= 1)).all()
    labels = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    model = learn(documents([(1, "text"), (None, "other"), (2, None)]), labels)
    assert isinstance(model, Model) and score(documents([]), model).count() == 0
    assert learn(documents([]), labels.limit(0)).scores(["a"])[0] == pytest.approx(0.1)


def test_odd_rows_and_clashing_columns(spark, documents, odd):
    rows = [*odd, *[(1000 + k, t) for k, (t, _) in enumerate(made(400))]]
    toxic = {1000 + k: y for k, (_, y) in enumerate(made(400))}
    labels = [(i, y) for i, y in toxic.items() if i % 3] + [(1001, 0), (1001, 1), (None, 1)]
    labels = spark.createDataFrame([(i, y, "x") for i, y in labels], "doc_id long, toxic int, id string")
    docs = documents(rows)
    docs = docs.withColumn("toxicity", docs["word"]).withColumn("id", docs["word"])
    got = score(docs, learn(docs, labels), out_col="toxicity")
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(round(r.toxicity, 12))
    assert all(len(x) == 1 for x in by.values())  # by text alone
    assert np.mean([(r.toxicity >= 0.5) == toxic[r.doc_id] for r in got if r.doc_id in toxic and r.doc_id != 1001]) > 0.95


def test_query_on_held_out_labels(spark):
    """Whole tables: scores equal those of a model and a loop of one text at a time, and tell held-out labels apart."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r for r in op11_toxicity(spark, folder).collect()}
    assert len(got) == docs.count()
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    for r in docs.orderBy("doc_id").limit(40).collect():
        assert got[r.doc_id].score == pytest.approx(model.scores([r.text or ""])[0]) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
    rest = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    s, y = np.array([x.score for x, _ in rest]), np.array([t for _, t in rest], bool)
    ahead = (s[y][:, None] > s[~y]).mean() + (s[y][:, None] == s[~y]).mean() / 2
    called = np.array([x.predicted for x, _ in rest], bool)
    assert ahead > 0.96 and (called & y).sum() / called.sum() > 0.9 and (called & y).sum() / y.sum() > 0.8

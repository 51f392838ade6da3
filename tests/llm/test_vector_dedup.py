import numpy as np

from tessera.llm.vector_dedup import _shortest, cells, decode, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, cells string, unit string, links string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", "x", "x", "x") for i, v, y in rows], SCHEMA)


def brute(rows):
    """n_links and component by every pair, in double precision."""
    ids = [i for i, _, _ in rows]
    n, root = dict.fromkeys(ids, 0), {i: i for i in ids}
    x = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.98]
    for a, b in pairs:
        n[ids[a]] += 1
        n[ids[b]] += 1
    for _ in range(len(ids)):
        for a, b in pairs:
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
    return {(i, n[i], root[i], root[i] == i) for i in ids}


def test_lattice():
    rng = np.random.default_rng(1)
    assert len(_shortest()) == 240 and np.allclose((_shortest() ** 2).sum(axis=1), 2)
    x = rng.normal(0, 2, (300, 8))
    own = decode(x)
    near = ((x[:, None, :] - own[:, None, :] - _shortest()[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - own) ** 2).sum(axis=1) <= near + 1e-12).all()  # no neighbouring point is nearer
    assert np.allclose(decode(own), own)


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 2, 5]))):
            rows.append((len(rows), base + rng.normal(size=24) * rng.choice([0.0, 0.02, 0.1, 0.14, 0.2]), int(g % 3)))
    rows += [(1000 + k, rows[0][1] * (1 + k), 0) for k in range(4)] + [(2000 + k, rows[0][1], 0) for k in range(5)] + [(3000, rows[0][1], 1)]
    got = {tuple(r) for r in vector_dedup(frame(spark, rows)).collect()}
    want = brute(rows)
    assert sum(r[1] for r in want) > 100
    missed = sum(r[1] for r in want) - sum(r[1] for r in got)
    assert 0 <= missed <= 0.01 * sum(r[1] for r in want)
    if not missed:
        assert got == want


def test_a_large_group_is_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(k, base + rng.normal(size=16) * 0.01, 4) for k in range(700)]
    got = vector_dedup(frame(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(699, 0)} and sum(r.kept for r in got) == 1


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1.0, 2.0, 0.0], 0), (None, [1.0, 2.0], 0), (12, [1e-30, 2e-30], 0), (13, [1e38, 2e38], 0), (14, [-1.0, -2.0], 0)]
    got = {r.vec_id: tuple(r)[1:] for r in vector_dedup(frame(spark, rows)).collect()}
    linked = {8, 9, 10, 12, 13}
    assert got == {i: (4, 8, i == 8) if i in linked else (0, i, True) for i, _, _ in rows}
    assert vector_dedup(frame(spark, [])).count() == 0


def test_recall_of_shared_cells():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y  # pairs right at the threshold
    group = np.zeros(2000, np.uint64)
    a, b = cells(x, group), cells(y, group)
    met = [bool(np.intersect1d(p[p >= 0], q[q >= 0]).size) for p, q in zip(a, b, strict=True)]
    assert np.mean(met) > 0.98

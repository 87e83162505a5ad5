import numpy as np

from vigil.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, component string, n_links string"


def brute(rows):
    n = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    ids = sorted({r[0] for r in rows if r[0] is not None})
    vec = {}
    for r in n:
        vec.setdefault(r[0], r)
    links, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in vec:
        for b in vec:
            if a < b and vec[a][2] == vec[b][2] and len(vec[a][1]) == len(vec[b][1]):
                x, y = (np.float32(vec[k][1]).astype(float) for k in (a, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (links[i], find(i)) for i in ids}


def awkward_rows():
    rng = np.random.default_rng(3)
    rows = [(1, None, 0), (2, [0.0] * 8, 0), (3, [float("nan")] + [1.0] * 7, 0), (4, [None] + [1.0] * 7, 0), (5, [float("inf")] + [1.0] * 7, 0),
            (6, [], 0), (7, [1.0], 0), (8, [1.0] * 8, None), (9, [1.0] * 8, 0), (9, [1.0] * 8, 0), (10, [2.0] * 8, 0), (11, [1.0] * 8, 1),
            (None, [1.0] * 8, 0), (12, [1e30] * 8, 0), (13, [1e-30] * 8, 0)]
    hot = rng.normal(size=8)
    for i in range(150):
        rows.append((100 + i, (hot + rng.normal(size=8) * (0.02 if i % 3 else 0.2)).tolist(), 2))
    for i in range(60):
        rows.append((300 + i, rng.normal(size=8).tolist(), int(i % 2)))
    return [(*r, "x", 1, "x", "x") for r in rows]


def check(spark, rows):
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and r.kept and r.n_links == 0
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_awkward_rows_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 64)  # many tiles, blocks and borders
    monkeypatch.setattr(D.link_counts, "__defaults__", (D.SIMILARITY, 16))
    check(spark, awkward_rows())


def test_vectors_of_three_lengths(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 64)
    rng = np.random.default_rng(8)
    rows = []
    for n, size in ((5, 8), (60, 2), (40, 3), (45, 8)):
        base = rng.normal(size=size)
        rows += [(len(rows) + i, (base + rng.normal(size=size) * 0.1 * (i % 4)).tolist(), int(i % 2)) for i in range(n)]
    rows += [(100_000, [1.0, 2.0], 7), (100_001, [1.0, 2.0], 7), (100_002, [1.0, 2.0, 0.0], 7)]
    check(spark, [(*r, "x", 1, "x", "x") for r in rows])


def test_a_chain_far_around_its_first_vector(spark, monkeypatch):
    """a component that winds through all angles, in many rings and blocks"""
    monkeypatch.setattr(D.link_counts, "__defaults__", (D.SIMILARITY, 8))
    rng = np.random.default_rng(11)
    rows = []
    for i in range(260):
        a = np.pi * i / 150
        rows.append((i, [float(np.cos(a)), float(np.sin(a)), float(0.05 * rng.normal()), float(0.05 * rng.normal()), 0.0, 0.0, 0.0, 1e-3], 0, "x", 1, "x", "x"))
    check(spark, rows)


def test_passes_follow_the_rows():
    assert D.passes_for(0) == D.passes_for(1000) == D.PASSES
    sizes = [D.passes_for(10 ** k) for k in range(3, 12)]
    assert sizes == sorted(sizes) and 20 < sizes[-3] < 50
    agree = 1 - np.arccos(0.98) / np.pi
    assert (1 - agree ** np.log2(1e9 / D.WINDOW)) ** D.passes_for(10 ** 9) <= D.MISSED


def test_isolated_pairs_at_the_threshold_are_found(spark, monkeypatch):
    """recall of pairs of cosine just above 0.98 among vectors of no structure, with narrow windows, at two sizes"""
    rng = np.random.default_rng(4)
    for n in (1500, 6000):
        m = rng.normal(size=(n, 24))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        side = rng.normal(size=(n // 2, 24))
        even = m[0::2]
        side -= (side * even).sum(axis=1, keepdims=True) * even
        m[1::2] = 0.9805 * even + np.sqrt(1 - 0.9805 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        rows = [(i, v.tolist(), 0, "x", 1, "x", "x") for i, v in enumerate(m)]
        got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), window=4).collect()
        assert sum(r.n_links >= 1 for r in got) >= 0.98 * n


def test_empty_table(spark):
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []

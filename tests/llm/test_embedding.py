import numpy as np

from genospark.llm import embedding_dedup as E


def clusters(seed=1, n=40, size=12, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        center = rng.standard_normal(dim)
        out += [center + rng.standard_normal(dim) * s for s in rng.choice([0.0, 0.1, 0.2, 0.3, 0.5], size)]
    return np.array(out, dtype=np.float32)


def brute(rows, cosine=0.93):
    good = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and k is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {i: 0 for i, _, _ in good}
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, a, k) in enumerate(good):
        for j, b, m in good[:p]:
            if k == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return n, {i: find(i) for i in parent}


def rows_of():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], int(rng.integers(3))) for i, v in enumerate(clusters())]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(1010, [2 * x for x in rows[7][1]], rows[7][2]), (1011, rows[7][1], None)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [None] * 24, 1), (2005, [float("inf")] + [0.0] * 23, 1), (None, rows[5][1], rows[5][2]), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 60)
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = rows_of()
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = E.near_vectors(frame).collect()
    links, parts = brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v], k) for i, v, k in rows])
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    for r in got:
        i = r["vec_id"]
        assert r["n_links"] <= links.get(i, 0)
        assert r["kept"] == (i is None or r["component_id"] == i)
        if i is not None and i >= 2000 and i < 2006:
            assert (r["n_links"], r["component_id"]) == (0, i)
    assert found >= 0.9 * sum(links.values())
    assert np.mean([r["component_id"] == parts.get(r["vec_id"], r["vec_id"]) for r in got]) > 0.9


def test_forest_splits():
    x = clusters(n=300, size=5)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    trees = E.fit(x, len(x), leaf=100)
    assert len(trees) == E.TREES and all(t.leaves > 4 for t in trees)
    for t in trees:
        got = t.leaves_of(x)
        assert all(got) and all(t.first <= k < t.first + t.leaves for own in got for k in own)


def test_dense_group_is_one_leaf():
    same = np.ones((500, 8)) + np.random.default_rng(0).standard_normal((500, 8)) * 1e-9
    same /= np.linalg.norm(same, axis=1, keepdims=True)
    half = np.concatenate([same, np.random.default_rng(1).standard_normal((500, 8))])
    half /= np.linalg.norm(half, axis=1, keepdims=True)
    for t in E.fit(half, 1000, leaf=50):
        own = t.leaves_of(half[:500])
        common = set(own[0]).intersection(*own)
        assert common  # no cut parts the group


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0

import random

import numpy as np

from genospark.llm import setsketch_dedup as S


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, percent=80):
    """component by doc_id, comparing all pairs."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, sets(t)) for i, t in rows if i is not None and sets(t)]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ka", "mo", "ti", "ru"]) + rng.choice(["na", "lo", "se", "vi", "du"]) + rng.choice("abcdefgh")
    out, i = [], 10
    for _ in range(6):
        base = [word() for _ in range(rng.choice([5, 40, 120]))]
        for _ in range(25):  # many of them heavily edited, so that leaders do not reach each other's copies
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5 and len(copy) > 4:
                    del copy[at]
                else:
                    copy[at] = word()
            out.append((i, " ".join(copy)))
            i += 1
    out += [(i + k, " ".join(word() for _ in range(60))) for k in range(20)]
    out += [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "ONE"), (7, "x " * 3000), (8, "x " * 2999), (9, "É é"), (9, "É é"), (None, "one two"), (None, None)]
    return out


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, component_id int")
    got = S.near_duplicates(docs).collect()
    wanted = brute(rows)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == wanted[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == len(sets(text[r["doc_id"]]))


def test_across_components(spark):
    """A group whose members are linked in chains that no leader sees as a whole."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(0, 150, 5), rng.choice([1, 4, 6, 7, 8])):
            copy[at] = f"e{at}{rng.randrange(2)}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_sketch():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**64, 600, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    ka, kb = S.registers(a), S.registers(b)
    estimate = S.estimated_jaccard(ka[None], kb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(estimate - true) < 0.15
    assert (S.merged(ka, kb) == S.registers(np.union1d(a, b))).all()
    assert S.estimated_jaccard(ka[None], ka[None], np.array([9.0]), np.array([9.0]))[0] > 0.99


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["component_id"] == 1


def test_components(spark):
    from genospark.llm.components import components
    from genospark.llm.storage import Scratch

    rng = random.Random(2)
    path = list(range(200))
    rng.shuffle(path)
    links = [(i, i + 1) for i in range(300, 420)] + list(zip(path, path[1:])) + [(500, 500)] + [(600, x) for x in range(601, 650)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 300 for i in range(300, 421)}, **{i: 0 for i in range(200)}, **{i: 600 for i in range(600, 650)}}


def test_repeated_rows_do_not_multiply(spark):
    """Two near copies, and a doc_id that a third of the rows share, a thousand rows each: the pairs to confirm stay few."""
    near = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y 1"]
    rows = [(i, t) for i, t in enumerate(near) for _ in range(1000)] + [(7, f"w{n} some words of row {n} alone") for n in range(1000)]
    got = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 0), (1, 0), (7, 7)}


def test_rows_of_one_document_join_its_neighbours(spark):
    one, other = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(5, one), (5, other), (3, one), (9, other), (4, "z"), (4, None)]
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4}

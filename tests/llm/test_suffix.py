import random

import numpy as np

from genospark.llm import suffix_dedup as D


def brute(rows, size):
    where = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            for s in range(len(w) - size + 1):
                where.setdefault(tuple(w[s : s + size]), set()).add(i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        starts = [s for s in range(len(w) - size + 1) if i is not None and len(where[tuple(w[s : s + size])]) > 1]
        if starts:
            out[i] = D.merged_spans(np.array(starts), size)
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 70, 120, 49, 300)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            cut = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            text += p[cut:] + [word() for _ in range(rng.randrange(20))]
        rows.append((i, " ".join(text)))
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (502, "the " * 400), (503, "the " * 130), (504, "solo " * 300), (505, None), (506, ""), (None, rows[3][1]), (507, rows[5][1]), (507, rows[5][1])]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, digest string")
    got = D.repeated_passages(frame).collect()
    wanted = brute(rows, D.SIZE)
    assert {r["doc_id"] for r in got} == set(wanted)
    for r in got:
        assert [tuple(s) for s in r["spans"]] == wanted[r["doc_id"]]
        assert r["n_repeated"] == sum(b - a for a, b in wanted[r["doc_id"]])
    assert 504 not in {r["doc_id"] for r in got}


def test_minimisers_agree():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 400, dtype=np.uint64)
    place, grams = D.minimisers(h)
    again, _ = D.minimisers(h[37:])
    assert (place[37:] - 37 == again).all() and len(grams) == 391
    for s in range(len(place)):
        assert place[s] == s + int(np.argmin(grams[s : s + 41]))
    runs = D.run_hashes(h, 50)
    assert (runs[37:] == D.run_hashes(h[37:], 50)).all() and len(np.unique(runs)) == len(runs)


def test_empty(spark):
    assert D.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_cut_by_borders(spark, monkeypatch):
    """A passage that most documents share, left and right partners that are no neighbours, and chunks of a few rows."""
    rng = random.Random(4)
    core = [f"c{n}" for n in range(12)]
    lefts, rights = [[f"l{k}x{n}" for n in range(45)] for k in range(4)], [[f"r{k}x{n}" for n in range(45)] for k in range(4)]
    rows = []
    for i in range(150):
        left, right = list(rng.choice(lefts)), list(rng.choice(rights))
        left[rng.randrange(45)], right[rng.randrange(45)] = f"u{i}", f"v{i}"
        rows.append((i, " ".join(left + core + right)))
    rows += [(i, t) for i, t in rows[:3]] * 5 + [(200, rows[0][1] + " " + "y" * 100_000), (7, "another text of document seven " + " ".join(core))]
    wanted = brute(rows[:150] + rows[165:166], D.SIZE)
    for chunk in (7, 60, 20_000):
        monkeypatch.setattr(D, "CHUNK", chunk)
        got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_words"] > 50}
        assert got == wanted


def test_document_with_two_texts(spark):
    """A text of document 5 that document 7 has too is repeated wherever document 5's other text holds its words."""
    words = " ".join(f"w{n}" for n in range(60))
    rows = [(5, words), (7, words), (5, "before " + words), (8, "x " * 70), (8, "x " * 70), (8, "y " + "x " * 70)]
    got = sorted((r["doc_id"], r["n_words"], r["n_repeated"]) for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 60, 60), (5, 61, 60), (7, 60, 60)]

import random

import numpy as np

from genospark.llm import decontamination as D


def fewest_edits(passage: bytes, text: bytes) -> int:
    row, lane, letters = np.zeros(len(text) + 1, int), np.arange(len(text) + 1), np.frombuffer(text, np.uint8)
    for c in passage:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (letters != c), row[1:] + 1)
        row = np.minimum.accumulate(new - lane) + lane
    return int(row.min())


def test_against_full_alignment():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    items = [(i, text(rng.choice([8, 15, 30, 60, 120, 250]))) for i in range(25)]
    index = D.PassageIndex(items)
    hits = 0
    for _ in range(150):
        p = list(rng.choice(items)[1])
        for _ in range(rng.randrange(int(len(p) * 0.16) + 1)):
            at = rng.randrange(len(p))
            kind = rng.randrange(3)
            if kind == 0:
                p[at] = rng.choice("abcde ")
            elif kind == 1:
                p.insert(at, rng.choice("abcde "))
            elif len(p) > 1:
                del p[at]
        doc = text(rng.randrange(150)) + "".join(p) + text(rng.randrange(150))
        whole = D.normalise(doc)
        wanted = {}
        for i, q in items:
            q = D.normalise(q)
            if len(q) >= D.Q and (e := fewest_edits(q, whole)) <= D.edit_budget(len(q)):
                wanted[i] = e
        assert {i: e for i, _, _, e in index.search(doc)} == wanted
        hits += len(wanted)
    assert hits > 60


def test_places_and_case():
    index = D.PassageIndex([(1, "The quick brown fox, jumps over the lazy dog."), (2, None), (3, "short"), (4, "")])
    text = "intro THE QUICK  brown fox; jumps over\nthe lazy dog and more"
    (item, start, end, edits), = index.search(text)
    assert item == 1 and edits == 0 and D.normalise(text)[start:end] == b"the quick brown fox jumps over the lazy dog"
    assert index.search("the quick brown") == [] and index.search("") == [] and index.search(None) == []


def test_frames(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, None), (4, "tiny")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta epsilon zeta y", 0), (1, "clean", 0), (2, None, 0), (3, "", 0), (None, "alpha beta gamma delta epsilon zeta", 0), (4, "alpha beta gamma " * 5000, 0), (5, "w " * 40000 + "alpha beta gammo delta epsilon zeta", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in D.find_passages(docs, benchmark).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 2, 0), (5, 1, 1), (5, 2, 1)]
    clean = D.clean_rows(docs, benchmark)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["1", "2", "3", "4"]
    assert D.find_passages(docs, benchmark.limit(0)).count() == 0 and D.find_passages(docs.limit(0), benchmark).count() == 0
    parts = D.blocks(benchmark, limit=30)
    assert len(parts) > 2 and sorted(r["item_id"] for b in parts for r in b.collect()) == [1, 2, 4]
    several = D.find_passages(docs, benchmark, limit=30)
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in several.collect()) == got
    assert sorted(str(r["doc_id"]) for r in D.clean_rows(docs, benchmark, limit=30).collect()) == ["1", "2", "3", "4"]


def test_short_passages_are_whole_words():
    index = D.PassageIndex([(1, "Tiny"), (2, "a-b c"), (3, "tiny"), (4, "!?"), (5, "alpha beta gamma")])
    assert index.search("some tiny thing, A b: c") == [(1, 5, 9, 0), (2, 16, 21, 0), (3, 5, 9, 0)]
    assert index.search("tinyish b c a b") == [] and index.search("tiny") == [(1, 0, 4, 0), (3, 0, 4, 0)]


def test_places_in_characters(spark):
    text = "  Ünï -- The QUICK, brown\tfox İ jumps!  End"
    passage = "quick brown fox İ jumps"
    hit, = D.find_passages(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()
    assert text[hit["char_start"] : hit["char_end"]] == "QUICK, brown\tfox İ jumps"

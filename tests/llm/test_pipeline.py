"""The pipeline's stages against plain Python on a small corpus."""

import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from genospark.llm import decontamination, line_dedup  # noqa: E402
from genospark.llm.queries import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def test_run(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    passages = decontamination.PassageIndex([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    docs = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    spread = {}
    for d in docs:
        for line in d["text"].split("\n"):
            spread.setdefault(line.strip(" \t\r"), set()).add(d["source"])
    for d in docs:
        d["text"] = "\n".join(x for x in d["text"].split("\n") if not x.strip(" \t\r") or len(spread[x.strip(" \t\r")]) < line_dedup.SITES)
    part = {d["doc_id"]: d["doc_id"] for d in docs}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    known = [(d["doc_id"], sets(d["text"])) for d in docs]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                part[max(x, y)] = min(x, y)
    left = {d["doc_id"]: d["text"] for d in docs if find(d["doc_id"]) == d["doc_id"] and not passages.search(d["text"])}
    got = {r["doc_id"]: r for r in pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(left)
    from genospark.llm.bpe_codec import BpeCodec, VOCABULARY
    from genospark.llm.queries import vocabulary

    own = BpeCodec(vocabulary(VOCABULARY))
    for i, text in left.items():
        assert list(got[i]["input_ids"]) == own.encode(text) and got[i]["n_tokens"] == len(got[i]["input_ids"])


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words of a text", None, "s", 3), (3, "12 34", "en", "s", 5), (3, "plain words of a text here", "en", "s", 26), (3, "plain words of a text here", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["3", "None"]
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 2
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0


def test_queries_over_small_tables(spark, duck):
    for name, query in QUERIES.items():
        frame = query(spark, SMALL)
        assert frame.columns
        if name in ORACLES:
            got = sorted(map(str, map(tuple, frame.select(*sorted(frame.columns)).collect())))
            wanted = duck.execute(ORACLES[name]).df()
            assert got == sorted(str(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in wanted[sorted(wanted.columns)].itertuples(index=False, name=None))

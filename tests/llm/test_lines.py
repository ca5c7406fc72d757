import random

import duckdb
import pandas as pd

from genospark.llm import line_dedup as L

PYTHON_NODES = ("Python", "Pandas", "Arrow")


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lines = [f"line {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))]
        for k, spread in enumerate((9, 10, 11, 12, 20, 3)):
            if rng.random() < 0.4 and i % 20 < spread:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", " ", "\t"]) + f"shared {k}" + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines), f"s{i % 20}"))
    return rows + [(900, None, "s1"), (901, "", "s1"), (902, "\n \n", None), (903, "shared 4", None), (903, "shared 4", None), (None, "shared 4\nkeep", "s2"), (904, "z" * 100_000 + "\nshared 4", "s3")]


def test_against_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, n_lines string, h1 int")
    frame = L.remove_boilerplate(docs)
    assert sorted(frame.columns) == ["doc_id", "h1", "n_lines", "n_removed", "source", "text"]
    got = sorted(map(str, frame.select("doc_id", "text", "n_lines", "n_removed").collect()))
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    connection = duckdb.connect()
    connection.register("documents", documents)
    from pyspark.sql import Row

    wanted = sorted(str(Row(doc_id=a, text=b, n_lines=c, n_removed=d)) for a, b, c, d in connection.execute(L.oracle()).fetchall())
    assert got == wanted
    assert any(r["n_removed"] for r in frame.collect())


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    plan = L.remove_boilerplate(docs)._jdf.queryExecution().toString()
    assert not any(node in plan for node in PYTHON_NODES)


def test_sketches_merge(spark):
    lines = spark.range(1000).selectExpr("1L as h1", "2L as h2", "concat('s', id % 300) as site")
    both = L.merged(L.site_sketches(lines.where("site < 's2'")), L.site_sketches(lines)).selectExpr("hll_sketch_estimate(sketch) as n").first()["n"]
    assert abs(both - 300) < 20


def test_empty(spark):
    assert L.remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_many_bad_lines_of_a_document(spark):
    """Documents of thousands of lines on many sites each, and many rows without id."""
    rows = [(i, "\n".join(f"line {n}" for n in range(6000)) + f"\nown {i}", f"s{i}") for i in range(12)] + [(None, f"line 7\nown {k}", None) for k in range(50)]
    got = L.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["text"] for r in got) == sorted(t.rpartition("\n")[2] for _, t, _ in rows)
    assert all(r["n_lines"] - r["n_removed"] == 1 for r in got)

"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in ``links`` (a, b: long, not null).

    By contraction: each round every node takes the label of the first of its neighbours and itself, links are relabelled, and loops and
    repeats go, until no link is left. First means smallest in even rounds, which folds a star at once, and smallest hash in odd rounds,
    by which a fixed share of the nodes of any other graph goes, so that rounds grow with the logarithm of its size. A node's neighbours
    meet only in an aggregate; every round is a written table.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges0")
    labels, n = None, 0
    while not edges.isEmpty():
        first = _first(n)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(first(F.col("b"))).alias("f")).select(F.col("a").alias("v"), F.least(first(F.col("a")), F.col("f"))["id"].alias("m"))
        step = scratch.save(step, f"{name}-step{n}")
        to = {c: step.select(F.col("v").alias(f"v{c}"), F.col("m").alias(f"m{c}")) for c in "ab"}
        moved = edges.join(to["a"], F.col("a") == F.col("va")).join(to["b"], F.col("b") == F.col("vb"))
        moved = moved.where("ma <> mb").select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")).distinct()
        if labels is None:
            labels = step.select(F.col("v").alias("id"), F.col("m").alias("component"))
        else:
            followed = labels.join(step, F.col("component") == F.col("v"), "left").select("id", F.coalesce("m", "component").alias("component"))
            labels = scratch.save(followed, f"{name}-labels{n}")
        edges = scratch.save(moved, f"{name}-edges{n + 1}")
        scratch.drop(f"{name}-edges{n}", *([f"{name}-labels{n - 1}"] if n > 1 else []))
        n += 1
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if n > 1:  # a label chosen by hash need not be the smallest of its nodes
        least = scratch.save(labels.groupBy("component").agg(F.min("id").alias("least")).withColumnRenamed("component", "c"), f"{name}-least")
        labels = labels.join(least, F.col("component") == F.col("c")).select("id", F.col("least").alias("component"))
    return labels


def _first(n: int):
    def first(c: Column) -> Column:
        return F.struct((c if n % 2 == 0 else F.xxhash64(F.lit(n), c)).alias("rank"), c.alias("id"))

    return first

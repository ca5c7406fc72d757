"""Near-duplicate embeddings by a random-projection tree forest.

Each tree halves the space level after level along a random direction; vectors near a cut go to both sides (spill). Vectors that share a
leaf in any tree are compared in double precision, in blocks of bounded size. Trees are fitted to a bounded sample, every vector is
indexed. A cut is put where few sampled vectors lie; a part that no cut leaves whole, a dense group, stays one leaf of any size, and its
blocks are compared pair by pair, so nothing depends on a cap. Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genospark.llm.components import components
from genospark.llm.storage import Scratch

TREES, LEAF, BLOCK = 8, 1000, 1024  # LEAF counts vectors of one label, as only these are compared
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000  # vectors, and numbers in them, that the trees are fitted to
SPILL = 0.16  # of a node's standard deviation along the cut, to either side of it
MARGIN = 1e-4  # under the threshold, for cosines in single precision
DENSE = 0.45  # a cut with more of the sample than this in its spill band is none


@dataclass
class Tree:
    directions: np.ndarray  # one for each level
    nodes: list[tuple[float, float, int, int]]  # cut, margin, children; a negative child -1 - k is leaf k
    first: int  # number of this tree's first leaf
    leaves: int

    def leaves_of(self, x: np.ndarray) -> list[list[int]]:
        """The leaves of each row of unit vectors, in rising order."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        shadow = x @ self.directions.T if len(self.directions) else None
        todo = [(0 if self.nodes else -1, 0, np.arange(len(x)))]
        while todo:
            node, level, rows = todo.pop()
            if node < 0:
                for r in rows:
                    out[r].append(self.first - 1 - node)
                continue
            cut, margin, low, high = self.nodes[node]
            at = shadow[rows, level]
            for child, chosen in ((low, rows[at <= cut + margin]), (high, rows[at >= cut - margin])):
                if len(chosen):
                    todo.append((child, level + 1, chosen))
        return [sorted(o) for o in out]


def fit(sample: np.ndarray, total: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7, first: int = 0) -> list[Tree]:
    """Trees over unit vectors, cut until a leaf is expected to hold at most ``leaf`` of ``total`` vectors."""
    rng, out = np.random.default_rng(seed), []
    depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf))) + 4)
    for _ in range(trees):
        directions = rng.standard_normal((depth, sample.shape[1])) / np.sqrt(sample.shape[1])
        shadow = sample @ directions.T
        nodes: list[tuple[float, float, int, int]] = []
        leaves = 0

        def grow(rows: np.ndarray, level: int) -> int:
            nonlocal leaves
            if level < depth and len(rows) >= 32 and len(rows) / len(sample) * total > leaf:
                at = shadow[rows, level]
                margin = SPILL * float(at.std())
                cuts = np.quantile(at, rng.uniform(0.3, 0.7, 8))
                near = np.array([((at >= c - margin) & (at <= c + margin)).mean() for c in cuts])
                best = int(near.argmin())
                if near[best] <= DENSE and margin > 0:
                    me = len(nodes)
                    nodes.append((0.0, 0.0, 0, 0))
                    low, high = grow(rows[at <= cuts[best] + margin], level + 1), grow(rows[at >= cuts[best] - margin], level + 1)
                    nodes[me] = (float(cuts[best]), margin, low, high)
                    return me
            leaves += 1
            return -leaves

        root = grow(np.arange(len(sample)), 0)
        assert root <= 0
        out.append(Tree(directions, nodes, first, leaves))
        first += leaves
    return out


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(list(rows), dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _fitted(classes: DataFrame) -> tuple[dict[int, list[Tree]], int]:
    """Trees for each vector length, and the number of leaves."""
    # a vector's peers are those of its label; lengths where it has few of them, on average, are one leaf each and need no tree
    labels = classes.groupBy("dim", "label").agg(F.count("*").cast("double").alias("n"))
    sizes = labels.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("peers"))
    forest, first = {}, 0
    for dim, n, peers in sizes.where(F.col("peers") > LEAF).orderBy("dim").collect():
        most = min(SAMPLE, max(1, SAMPLE_NUMBERS // dim))
        chance = F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(1_000_000)) < int(1e6 * min(1.0, most / n))
        sample = classes.where((F.col("dim") == dim) & chance).select("vec").limit(most).toPandas()["vec"]
        trees = fit(_unit(sample) if len(sample) else np.ones((1, dim)), peers, first=first)
        first = trees[-1].first + trees[-1].leaves
        forest[dim] = trees
    return forest, first


def _compare(cosine: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, _, _, bi, bj = key
        rows = rows.sort_values("rep", kind="stable")
        left, right = rows[rows["block"] == bi], rows[rows["block"] == bj]
        none = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        x = _unit(left["vec"])
        y = x if bi == bj else _unit(right["vec"])
        # single precision, and a margin far over its error, find who may have a link; double precision decides
        rough = x.astype(np.float32) @ y.astype(np.float32).T
        if bi == bj:
            np.fill_diagonal(rough, -1)
        rough = rough >= cosine - MARGIN
        a, b = np.flatnonzero(rough.any(axis=1)), np.flatnonzero(rough.any(axis=0))
        if not len(a):
            return none
        left, right = left.iloc[a], right.iloc[b]
        near = x[a] @ y[b].T >= cosine
        near &= left["rep"].to_numpy()[:, None] != right["rep"].to_numpy()[None, :]
        # a pair counts in the first leaf that its vectors share
        earlier = [[[k for k in leaves if k < leaf] for leaves in side["leaves"]] for side in (left, right)]
        number = {k: n for n, k in enumerate(sorted({k for side in earlier for own in side for k in own}))}
        if number:
            sets = [np.zeros((len(side), len(number)), np.float32) for side in earlier]
            for matrix, side in zip(sets, earlier):
                for r, own in enumerate(side):
                    matrix[r, [number[k] for k in own]] = 1
            near &= ~((sets[0] @ sets[1].T) > 0)
        reps = np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        n = len(left)
        links = np.concatenate([near @ right["c"].to_numpy(), near.T @ left["c"].to_numpy()])
        if bi == bj:
            links[n:] = 0
        root = reps.copy()
        while True:  # the smallest id around, until none is smaller
            before = root.copy()
            big = np.iinfo(np.int64).max
            root[:n] = np.minimum(root[:n], np.where(near, root[n:][None, :], big).min(axis=1))
            root[n:] = np.minimum(root[n:], np.where(near, root[:n][:, None], big).min(axis=0))
            if (before == root).all():
                break
        use = (links > 0) | (root != reps)
        return pd.DataFrame({"rep": reps[use], "links": links[use], "root": root[use]})

    return compare


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows of one label and one length are linked where their cosine, in double precision, is at least ``cosine``. Vectors that are null,
    empty, zero, or hold null or non-finite numbers, and rows without label or id, link with nothing. n_links counts the other rows
    linked directly, equal vectors too; component_id is the smallest vec_id reachable, itself included (null where vec_id is). An empty
    table gives an empty one. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    held = vectors.schema[vec].dataType
    exact = held if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else "array<double>"  # floats are no longer for being doubles
    base = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[label].alias("label"), vectors[vec].cast(exact).alias("vec"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite) & (norm > 0) & (norm < float("inf"))
    hashes = [F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit("vector"), "vec", "label").alias("h2")]
    marked = base.select("id", "label", "vec", F.coalesce(good, F.lit(False)).alias("good"), *hashes)
    # equal vectors of a label meet in an aggregate; any of them stands for all
    grouped = marked.where("good").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    equal = scratch.save(grouped.withColumn("dim", F.size("vec")), "equal")
    classes = equal.select("rep", "c", "label", "vec", "dim", "h1", "h2")
    forest, end = _fitted(classes)
    shared = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE: cuts of sampled vectors, and a direction for each level

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            leaves: list[list[int]] = [[] for _ in range(len(batch))]
            for dim, rows in batch.groupby("dim").groups.items():
                trees = shared.value.get(dim)
                if trees is None:  # a length of its own: one leaf
                    for r in rows:
                        leaves[r] = [end + int(dim)]
                    continue
                x = _unit(batch["vec"].loc[rows])
                for tree in trees:
                    for r, own in zip(rows, tree.leaves_of(x)):
                        leaves[r] += own
            yield batch.assign(leaves=leaves)

    wanted = classes.select("rep", "c", "label", "vec", "dim")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    routed = wanted.mapInPandas(route, f"{fields}, leaves array<int>")
    routed = scratch.save(routed, "routed")
    placed = routed.select("*", F.explode("leaves").alias("leaf"))
    sizes = routed.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy("leaf", "label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    sizes = scratch.save(sizes.select("leaf", "label", "dim", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")), "sizes")
    dealt = placed.join(sizes, ["leaf", "label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    compared = dealt.select("leaf", "label", "dim", "bi", "bj", "block", "rep", "c", "vec", "leaves").groupBy("leaf", "label", "dim", "bi", "bj")
    found = scratch.save(compared.applyInPandas(_compare(cosine), "rep long, links long, root long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "r")
    parts = components(found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    whole = equal.select("h1", "h2", "rep", "c").join(counts, F.col("rep") == F.col("r"), "left").join(parts, F.col("rep") == parts["id"], "left")
    whole = whole.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("links"), F.coalesce("component", "rep").alias("part"))
    whole = scratch.save(whole, "whole")
    scratch.drop("equal", "routed", "sizes")
    rows = marked.select("id", "good", "h1", "h2").join(whole, F.col("good") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    out = rows.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Near duplicates by SetSketch registers.

A document is the set of its word shingles. Register k of its sketch holds, on an exponential scale, the least of the k-th hash over the
set: floor(1 - log_b(x)) of the smallest exponentially distributed value, cut off at both ends. Sketches of parts merge by maximum, and
registers agree with a probability that follows the Jaccard similarity. Bands of registers give buckets; a bucket's documents are
compared with its leaders, and then across the components that this leaves in it, never all with all. Pairs pass a joint
maximum-likelihood estimate from the registers before the full sets confirm them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.components import components
from genospark.llm.storage import Scratch

ROWS, BANDS = 5, 32  # a pair at similarity 0.8 meets in no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2  # b, a and q of the sketch: two bytes a register
SLACK = 0.18  # under the threshold, for the estimate: more than 5 standard errors of 160 registers
BLOCK, BLOCK_SETS = 250_000, 500  # shingles and sets a side of a block, about
_M = ROWS * BANDS
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 2**64, _M, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 2**63, _M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; fewer words are one shingle; no words, none.

    A-Z are lower-cased; words end at blanks and the characters 9 to 13. Shingles are told apart by their hashes alone.
    """
    found = text.encode("utf-8").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    total = np.full(n, min(size, len(h)), np.uint64)
    for i in range(min(size, len(h))):
        total = total * _P + _mixed(h[i : i + n] + _P)
    return np.unique(_mixed(total))


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, 16 bits a register."""
    least = np.full(_M, 2**64 - 1, np.uint64)
    for at in range(0, len(items), 128):  # a block of this height stays in the processor's cache
        least = np.minimum(least, ((items[at : at + 128, None] ^ _XOR) * _MULTIPLY).min(axis=0))
    exponential = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> list[int]:
    """A 64-bit bucket number for each band of registers."""
    data = sketch.tobytes()
    step = 2 * ROWS
    return [xxhash.xxh3_64_intdigest(data[k * step : (k + 1) * step], seed=k) - 2**63 for k in range(BANDS)]


def estimated_jaccard(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates for rows of registers ``ka``, ``kb`` of sets with ``na``, ``nb`` members."""
    more, less = (ka > kb).sum(axis=1), (ka < kb).sum(axis=1)
    same = ka.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        terms = ((more, a), (less, b), (same, 1 - a - b))
        return sum(np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0.0) for n, q in terms)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(x) >= likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _sketch_table(docs: DataFrame, size: int) -> DataFrame:
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, mark, text in zip(batch["id"], batch["mark"], batch["text"]):
                items = shingles(text, size)
                if not len(items):
                    rows.append((i, mark, 0, None, None, None))
                    continue
                own = registers(items)
                rows.append((i, mark, len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), own.tobytes(), band_keys(own)))
            yield pd.DataFrame(rows, columns=["id", "mark", "n", "digest", "regs", "keys"]).astype({"id": "Int64", "mark": "int64"})

    return docs.mapInPandas(sketch, "id long, mark long, n long, digest binary, regs binary, keys array<long>")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs whose estimated similarity isn't clearly below the threshold."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ka, kb = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, _M) for c in ("ra", "rb"))
                keep = estimated_jaccard(ka, kb, batch["na"].to_numpy(float), batch["nb"].to_numpy(float)) >= least
                yield batch.loc[keep, ["a", "b"]]

    one, other = (reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}")) for c in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "ra", "rb").mapInPandas(judge, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"]):
                if held != a:
                    held, left = a, shingles(ta, size)
                right = shingles(tb, size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both) and both > 0)
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    one, other = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(other, "b").join(one, "a").select("a", "b", "ta", "tb").mapInPandas(compare, "a long, b long")


def _across_components(across: DataFrame, reps: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links between different parts within each leader's company: (a, b).

    ``across`` has lead, id, part and main. Documents outside the main part meet all others in blocks of about BLOCK shingles or BLOCK_SETS
    sets a side, so a task's work is bounded and no row is made for a pair; of a document's links to one part, one is returned, which joins the parts.
    """

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"i": batch["id"], "items": [shingles(t, size).tobytes() for t in batch["text"]]})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        minor, other = rows[rows["minor"]], rows[~rows["minor"]]
        right = [np.frombuffer(b, np.uint64) for b in other["items"]]
        lengths = np.array([len(r) for r in right], np.int64)
        tokens = np.concatenate([*right, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(right)), lengths)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        ids, parts = other["id"].to_numpy(), other["part"].to_numpy()
        out = []
        for i, part, items in zip(minor["id"], minor["part"], minor["items"]):
            left = np.frombuffer(items, np.uint64)
            low, high = np.searchsorted(tokens, left, "left"), np.searchsorted(tokens, left, "right")
            many = high - low
            flat = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(owner[flat], minlength=len(right))
            hit = np.flatnonzero((100 * both >= percent * (len(left) + lengths - both)) & (parts != part) & (both > 0))
            _, first = np.unique(parts[hit], return_index=True)
            out += [(i, b) for b in ids[hit[first]]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    sized = across.join(reps.select("id", "n"), "id")
    is_minor = F.col("part") != F.col("main")
    weight = F.greatest(F.col("n") / BLOCK, F.lit(1 / BLOCK_SETS))
    blocks = lambda total: F.ceil(F.coalesce(total, F.lit(0.0))).cast("int")
    totals = sized.groupBy("lead").agg(blocks(F.sum(F.when(is_minor, weight))).alias("gm"), blocks(F.sum(weight)).alias("go"))
    dealt = sized.join(scratch.save(totals, "totals"), "lead")  # both sides come from shuffles, so a large company's rows can be split
    sides = []
    for minor, own, others in ((True, "gm", "go"), (False, "go", "gm")):
        side = dealt.where(is_minor) if minor else dealt
        block = F.pmod(F.xxhash64("id", F.lit(minor)), F.col(own)).cast("int").alias("bi" if minor else "bj")
        each = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("bj" if minor else "bi")
        sides.append(side.select("lead", "id", "part", F.lit(minor).alias("minor"), block, each))
    wanted = across.select("id").distinct()
    sets = texts.join(wanted, "id", "left_semi").mapInPandas(sets_of, "i long, items binary")
    rows = sides[0].unionByName(sides[1]).join(sets, F.col("id") == F.col("i"))
    return rows.select("lead", "bi", "bj", "id", "part", "minor", "items").groupBy("lead", "bi", "bj").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked where 100 * |A and B| >= percent * |A or B| over their sets of ``size``-word shingles; component_id is the
    smallest doc_id reachable by links, itself included. Null and empty texts, and texts of white space, have no shingles and link with
    nothing. Rows that share a doc_id are one document: links of any of them count for it. A row without doc_id links with nothing, has
    a null component_id and is kept. Repeated rows stay, and cost no more than one of them after the first grouping; an empty table gives
    an empty one. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "near")
    base = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text")).withColumn("mark", F.xxhash64("text"))
    sketches = scratch.save(_sketch_table(base, size), "sketches")
    known = sketches.where("n > 0 and id is not null")
    # A node is a set of shingles, whatever number of rows has it: its number is given once, in a written table. ``at`` is the row, up to
    # copies, whose text stands for it. Equal digests have equal sketches, so the first of them is any of them.
    grouped = known.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("at"), *[F.first(c).alias(c) for c in ("n", "regs", "keys")])
    nodes = scratch.save(grouped.select(F.monotonically_increasing_id().alias("id"), "digest", F.col("at.id").alias("doc"), F.col("at.mark").alias("mark"), "n", "regs", "keys"), "nodes")
    reps = nodes.select("id", "n", "regs")

    banded = nodes.select("id", F.explode("keys").alias("key"))
    buckets = scratch.save(banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low")).where("c > 1"), "buckets")
    members = scratch.save(banded.join(buckets, "key"), "members")
    # leaders of a bucket: its smallest node, and the member that meets most others over all bands, which is near the middle of a group
    central = scratch.save(members.groupBy("id").agg(F.sum("c").alias("w")), "central")
    leaders = members.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("lead"))
    leaders = scratch.save(leaders, "leaders")
    starred = members.select(F.col("low").alias("a"), F.col("id").alias("b")).unionByName(members.join(leaders, "key").select(F.col("lead").alias("a"), F.col("id").alias("b")))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = scratch.save(starred.where("a <> b").select(*ordered).distinct(), "pairs")

    wanted = nodes.join(central.select("id"), "id", "left_semi").select(F.col("id").alias("node"), "doc", F.col("mark").alias("m"))
    texts = base.join(wanted, (F.col("id") == F.col("doc")) & (F.col("mark") == F.col("m"))).dropDuplicates(["doc", "m"])
    texts = scratch.save(texts.select(F.col("node").alias("id"), "text"), "texts")
    least = percent / 100 - SLACK
    links = scratch.save(_confirmed(_likely(pairs, reps, least), texts, size, percent), "links")
    joined = components(links, scratch, "first")
    joined = scratch.save(joined.select(F.col("id").alias("i"), "component"), "joined")

    # what the leaders leave apart is compared across the components of each leader's company; the largest one needs no row of its own
    company = members.join(leaders, "key").select("lead", "id").distinct()
    placed = scratch.save(company.join(joined, F.col("id") == F.col("i"), "left").select("lead", "id", F.coalesce("component", "id").alias("part")), "placed")
    parts = placed.groupBy("lead", "part").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("lead").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("size", "part")).alias("main")).where("parts > 1")
    across = scratch.save(placed.join(scratch.save(mixed.select("lead", "main"), "mixed"), "lead"), "across")
    more = _across_components(across, reps, texts, scratch, size, percent)
    # the nodes of rows that share a doc_id are one document
    held = known.groupBy("id", "digest").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("sets"), F.min("digest").alias("least")).where("sets > 1")
    held = scratch.save(held.select(F.col("id").alias("h"), "least"), "held")
    several = known.select("id", "digest").distinct().join(held, F.col("id") == F.col("h")).where("digest <> least").select("digest", "least")
    number = {c: nodes.select(F.col("digest").alias(f"d{c}"), F.col("id").alias(c)) for c in "ab"}
    shared = several.join(number["a"], F.col("digest") == F.col("da")).join(number["b"], F.col("least") == F.col("db")).select("a", "b")
    links = scratch.save(links.unionByName(more).unionByName(shared), "all_links")
    found = scratch.save(components(links, scratch, "last").select(F.col("id").alias("node"), "component"), "found")

    # the smallest doc_id of each component
    of_node = nodes.select("id", "doc", F.col("digest").alias("d")).join(found, F.col("id") == F.col("node"), "left").select("d", "doc", F.coalesce("component", "id").alias("c"))
    of_node = scratch.save(of_node, "of_node")
    least = scratch.save(of_node.groupBy("c").agg(F.min("doc").alias("first"), F.count("*").alias("nodes")).where("nodes > 1").select(F.col("c").alias("k"), "first"), "least")
    of_class = scratch.save(of_node.join(least, F.col("c") == F.col("k"), "left").select("d", F.coalesce("first", "doc").alias("first")), "of_class")
    scratch.drop("nodes", "buckets", "members", "central", "leaders", "pairs", "texts", "links", "joined", "placed", "mixed", "across", "totals", "held", "all_links", "found", "of_node", "least")
    rows = sketches.select("id", "n", "digest").join(of_class, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("first", "id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

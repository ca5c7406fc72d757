"""Interval operators over REGION tables (id, chr, pos1, pos2, strand); intervals are closed and bounds are signed.

Overlap joins go through bins: each side is spread over the bins it touches, joined on (chr, bin), and a pair is kept in the bin where
its intersection begins, so no pair is made twice and none needs a distinct. Wide intervals get coarser bins, so one that spans a
chromosome touches few; narrow ones wait for them in the coarser bins too, apart from each other, where the other side has any.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the bin width of each level; an interval's level is the first on which it is at most 16 bins wide.
LEVELS = (10, 17, 24)


def _level(width: Column) -> Column:
    out = F.lit(LEVELS[-1])
    for bits in reversed(LEVELS[:-1]):
        out = F.when(width <= (1 << bits + 4), bits).otherwise(out)
    return out


def _prefixed(df: DataFrame, mark: str, columns: tuple[str, str, str], same: Sequence[str] = ()) -> DataFrame:
    """The row's columns stay apart, as ``<mark>.<column>``, so that a plan carries only those that are used."""
    chrom, p1, p2 = columns
    payload = [F.col(f"`{c}`").alias(f"{mark}.{c}") for c in df.columns]
    return df.select(F.col(chrom).alias("chr"), *same, F.col(p1).cast("long").alias(f"{mark}1"), F.col(p2).cast("long").alias(f"{mark}2"), *payload)


def pairs(queries: DataFrame, subjects: DataFrame, query_columns: tuple[str, str, str] = ("chr", "pos1", "pos2"), subject_columns: tuple[str, str, str] = ("chr", "pos1", "pos2"), same: Sequence[str] = ()) -> DataFrame:
    """Every overlapping pair once: chr, pos1, pos2 (the intersection) and the rows as structs ``q`` and ``s``.

    ``same``: columns that must be equal.
    """
    q, s = _prefixed(queries, "q", query_columns, same), _prefixed(subjects, "s", subject_columns, same)
    both = _spread(q, s)
    start, end = F.greatest("q1", "s1"), F.least("q2", "s2")
    met = both[0].join(both[1], ["chr", *same, "cell", "bin"])
    met = met.where((F.col("q1") <= F.col("s2")) & (F.col("s1") <= F.col("q2")))
    met = met.where(F.col("bin") == F.expr("shiftright(greatest(q1, s1), shiftright(cell, 1))"))
    rows = [F.struct(*[F.col(f"`{m}.{c}`").alias(c) for c in df.columns]).alias(m) for m, df in (("q", queries), ("s", subjects))]
    return met.select("chr", start.cast("int").alias("pos1"), end.cast("int").alias("pos2"), *rows)


def _spread(q: DataFrame, s: DataFrame) -> list[DataFrame]:
    """Both sides with a row for each cell and bin in which a pair could meet."""
    own = {mark: _level(F.col(f"{mark}2") - F.col(f"{mark}1") + 1) for mark in "qs"}
    # One row says on which levels each side has intervals, so that no cell is listed that nothing of the other side can lie in.
    held = {mark: side.agg(*[F.coalesce(F.max(own[mark] == b), F.lit(False)).alias(f"{mark}_{b}") for b in LEVELS]) for mark, side in (("q", q), ("s", s))}
    # A pair meets on the coarser of its two levels: in an even cell if that is the query's, in an odd one if the subject's is coarser. So a
    # query lists its own even cell and the odd ones of coarser levels, a subject the even ones from its own on and its own odd one.
    both = []
    for mark, other, side in (("q", "s", q), ("s", "q", s)):
        has = lambda *levels: functools.reduce(operator.or_, [F.col(f"{other}_{b}") for b in levels], F.lit(False))  # noqa: B023, E731
        cells = F.lit(None)
        for b in LEVELS:
            coarser, finer = [c for c in LEVELS if c > b], [c for c in LEVELS if c < b]
            lists = [(2 * b, has(*finer, b))] + [(2 * c + 1, has(c)) for c in coarser] if mark == "q" else [(2 * c, has(c)) for c in [b, *coarser]] + [(2 * b + 1, has(*finer))]
            cells = F.when(own[mark] == b, F.array(*[F.when(wanted, cell) for cell, wanted in lists])).otherwise(cells)
        spread = side.crossJoin(F.broadcast(held[other])).withColumn("cell", F.explode(F.array_compact(cells))).drop(*held[other].columns)
        both.append(spread.withColumn("bin", F.explode(F.expr(f"sequence(shiftright({mark}1, shiftright(cell, 1)), shiftright({mark}2, shiftright(cell, 1)))"))))
    return both


def overlap_join(queries: DataFrame, subjects: DataFrame, same_strand: bool = False) -> DataFrame:
    """query_id, subject_id and the trimmed intersection chr, pos1, pos2, strand '*'. With ``same_strand`` strands must be equal."""
    found = pairs(queries, subjects, same=["strand"] if same_strand else [])
    return found.select(F.col("q.id").alias("query_id"), F.col("s.id").alias("subject_id"), "chr", "pos1", "pos2", F.lit("*").alias("strand"))


def overlaps_of(subjects: DataFrame, chrom: int, pos1: int, pos2: int) -> DataFrame:
    """The subjects' intersections with one region, with subject_id: plain predicates that reach the scan."""
    hit = subjects.where((F.col("chr") == chrom) & (F.col("pos1") <= pos2) & (F.col("pos2") >= pos1))
    return hit.select(F.col("id").alias("subject_id"), "chr", F.greatest("pos1", F.lit(pos1)).alias("pos1"), F.least("pos2", F.lit(pos2)).alias("pos2"), F.lit("*").alias("strand"))


def overlapped_ids(subjects: DataFrame, chrom: int, pos1: int, pos2: int) -> DataFrame:
    return overlaps_of(subjects, chrom, pos1, pos2).select("subject_id")


def count_overlaps(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """query_id and n for every query, 0 too."""
    counts = overlap_join(queries, subjects).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select(F.col("id").alias("query_id")).join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _reach(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, chr, pos1, pos2, reach) of the queries that a subject overlaps: how far the subjects go that begin no later than its end.

    Running maxima within blocks of positions, on top of those of the blocks before, so no task holds a chromosome.
    """
    none = F.lit(None).cast("int")
    began = subjects.select("chr", F.col("pos1").alias("p"), F.lit(0).alias("kind"), F.col("pos2").cast("int").alias("e"), F.lit(None).cast(queries.schema["id"].dataType).alias("id"), none.alias("pos1"))
    asked = queries.select("chr", F.col("pos2").alias("p"), F.lit(1).alias("kind"), none.alias("e"), "id", "pos1")
    events = began.unionByName(asked).withColumn("block", F.shiftright("p", SWEEP_BITS))
    by_block = Window.partitionBy("chr").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("chr", "block").agg(F.max("e").alias("e")).select("chr", "block", F.max("e").over(by_block).alias("before"))
    inside = Window.partitionBy("chr", "block").orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept_up = events.join(blocks, ["chr", "block"]).withColumn("reach", F.greatest("before", F.max("e").over(inside)))
    return swept_up.where("kind = 1 and reach >= pos1").select("id", "chr", "pos1", F.col("p").alias("pos2"), "reach")


def share_subject(one: DataFrame, other: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id_a, id_b) of queries of two tables that overlap at least one common subject.

    A subject is common if it begins no later than the smaller end of the two and goes on to the larger start. So the one with the
    smaller end, and how far subjects go that begin up to there, tell all its partners: pairs are made once, never for each subject.
    """
    parts = []
    for first, second, mark, beside, law in ((one, other, "id_a", "id_b", "s.pos2 >= q.pos2"), (other, one, "id_b", "id_a", "s.pos2 > q.pos2")):
        anchors = _reach(first, subjects).withColumns({"low": F.least("pos2", "reach"), "high": F.greatest("pos2", "reach")})
        found = pairs(anchors, second, ("chr", "low", "high")).where(f"{law} and s.pos1 <= q.reach")
        parts.append(found.select(F.col("q.id").alias(mark), F.col("s.id").alias(beside)).select("id_a", "id_b"))
    met = parts[0].unionByName(parts[1])
    unique = [t.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty() for t in (one, other)]
    return met if all(unique) else met.distinct()  # an id of one interval meets each partner once


def overlap_width(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """query_id and the positions of it that subjects cover, each once; queries without overlap have 0."""
    hits = overlap_join(queries, subjects).select("query_id", "chr", "pos1", "pos2")
    widths = merged(hits, ["query_id", "chr"]).groupBy("query_id").agg(F.sum(F.col("pos2").cast("long") - F.col("pos1") + 1).alias("w"))
    return queries.select(F.col("id").alias("query_id")).join(widths, "query_id", "left").select("query_id", F.coalesce("w", F.lit(0)).cast("long").alias("width"))


def intersection(one: DataFrame, other: DataFrame) -> DataFrame:
    return pairs(one, other).select("chr", "pos1", "pos2")


def contained(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(query_id, subject_id) where the subject lies inside the query."""
    found = pairs(queries, subjects).where("s.pos1 >= q.pos1 and s.pos2 <= q.pos2")
    return found.select(F.col("q.id").alias("query_id"), F.col("s.id").alias("subject_id"))


def count_contained(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """query_id and n for every id of a query, 0 too: the subjects inside its queries. Nothing lies in a query that ends before it starts.

    Inside are those that end by the query's end, without those that start before it, but for those that do so and end after it. The
    first two are running counts over positions, the third is ``_count_around``: no pair is made. Equal subjects are one row from the start.
    """
    sound = F.coalesce(F.col("chr").isNotNull() & (F.col("pos1") <= F.col("pos2")), F.lit(False))
    named = queries.select("id", "chr", F.col("pos1").cast("long").alias("pos1"), F.col("pos2").cast("long").alias("pos2"), sound.alias("sound"))
    asking, rest = named.where("sound").drop("sound"), named.where("not sound").select("id", F.lit(0).cast("long").alias("n"))
    known = subjects.select("chr", F.col("pos1").cast("long").alias("pos1"), F.col("pos2").cast("long").alias("pos2")).where("chr is not null and pos1 is not null and pos2 is not null")
    known = known.groupBy("chr", "pos1", "pos2").agg(F.count("*").alias("n"))
    parts = [_count_before(asking, known), _count_around(asking, known), rest]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("n").alias("n")).select(F.col("id").alias("query_id"), "n")


def _count_before(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, n), two rows a query: the ``n`` of subjects that end by its end, and, below 0, of those that start before it.

    Running sums within blocks of positions, on top of the totals of the blocks before, for ends (side 1) and starts (side -1) apart.
    """
    at = lambda end, start: F.explode(F.array(F.struct(F.lit(1).alias("side"), end.alias("p")), F.struct(F.lit(-1).alias("side"), start.alias("p")))).alias("at")
    counts = subjects.select("chr", "n", at(F.col("pos2"), F.col("pos1"))).select("chr", "at.*", "n")
    asked = queries.select("id", "chr", at(F.col("pos2"), F.col("pos1") - 1)).select("id", "chr", "at.*")
    events = counts.unionByName(asked, allowMissingColumns=True).withColumn("block", F.shiftright("p", SWEEP_BITS))
    by_block = Window.partitionBy("chr", "side").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("chr", "side", "block").orderBy("p", F.asc_nulls_last("n")).rowsBetween(Window.unboundedPreceding, 0)
    # The queries' own n is null: it adds nothing and comes last at its position. Their blocks take part, so each finds the totals before it.
    blocks = events.groupBy("chr", "side", "block").agg(F.sum("n").alias("n")).select("chr", "side", "block", F.sum("n").over(by_block).alias("before"))
    so_far = F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return events.join(blocks, ["chr", "side", "block"]).withColumn("so_far", F.col("side") * so_far).where("n is null").select("id", F.col("so_far").alias("n"))


def _count_around(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, n), any number of rows a query, to be added up: the ``n`` of subjects that start before it and end after it.

    Of two numbers, the smaller has a 0 and the larger a 1 in the highest bit where they differ; the larger with all lower bits at 0 is a
    border between them. A subject is listed at the borders of this kind that it crosses, a query at those before its start that a subject
    could reach it from: the two share just one, where a running count by the end tells how many. So rows are bounded by the bits of a position.
    """
    first = -(1 << 31)  # positions count from here, so none is negative
    longest, narrowest = subjects.agg(F.max(F.expr("if(n > 0, pos2 - pos1, null)")).alias("longest")), queries.agg(F.min(F.expr("pos2 - pos1")).alias("narrowest"))
    crossing = subjects.crossJoin(F.broadcast(narrowest)).select("chr", "n", F.expr(f"pos2 - {first}").alias("e"), F.expr(f"pos1 - {first}").alias("low"), F.expr(f"pos2 - {first} - 1 - narrowest").alias("high"))
    asking = queries.crossJoin(F.broadcast(longest)).select("chr", "id", F.expr(f"pos2 - {first}").alias("e"), F.expr(f"greatest(pos2 - {first} + 1 - longest, 0)").alias("low"), F.expr(f"pos1 - {first}").alias("high"))
    bits = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("low").bitwiseXOR(F.col("high")))) - 1)).alias("bit")
    crossing = crossing.where("low < high").select("*", bits).where("shiftright(low, bit) & 1 = 0").withColumn("border", F.expr("shiftleft(shiftright(low, bit) + 1, bit)"))
    asking = asking.where("low < high").select("*", bits).where("shiftright(high, bit) & 1 = 1").withColumn("border", F.expr("shiftleft(shiftright(high, bit), bit)"))
    beyond = (F.col("e") - F.col("border")).alias("beyond")
    events = crossing.select("chr", "border", beyond, "n").unionByName(asking.select("chr", "border", beyond, "id"), allowMissingColumns=True)
    # The queries' own n is null: it adds nothing and comes first, so that subjects of the same end are not counted.
    further = Window.partitionBy("chr", "border").orderBy(F.desc("beyond"), F.asc_nulls_first("n")).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("sum", F.sum("n").over(further)).where("n is null and sum > 0").select("id", F.col("sum").alias("n"))


#: Positions to a block of a sweep: 32-bit coordinates make at most 2048 blocks a chromosome.
SWEEP_BITS = 20


def swept(events: DataFrame, *values: str) -> DataFrame:
    """Running sums of ``values`` over events (chr, p, values), one row per (chr, p), with the position of the next event in ``q``.

    Two levels, so no task holds a chromosome: sums within blocks of positions, on top of the totals of the blocks before.
    """
    summed = events.groupBy("chr", "p").agg(*[F.sum(v).alias(v) for v in values]).withColumn("block", F.shiftright(F.col("p"), SWEEP_BITS))
    summed = summed.where("chr is not null and block is not null")  # as the join asks for: said for both its sides, the events are summed once
    by_block = Window.partitionBy("chr").orderBy("block")
    totals = summed.groupBy("chr", "block").agg(F.min("p").alias("first"), *[F.sum(v).alias(v) for v in values])
    before = [F.coalesce(F.sum(v).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{v}") for v in values]
    totals = totals.select("chr", "block", F.lead("first").over(by_block).alias("next"), *before)
    inside = Window.partitionBy("chr", "block").orderBy("p")
    joined = summed.join(totals, ["chr", "block"])  # on the keys of the window that follows, so one shuffle serves both
    sums = [(F.col(f"before_{v}") + F.sum(v).over(inside)).alias(v) for v in values]
    return joined.select("chr", "p", F.coalesce(F.lead("p").over(inside), F.col("next")).alias("q"), *sums)


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """The parts (chr, pos1, pos2) of the union of ``one`` that ``other`` does not cover."""
    starts = [df.select("chr", F.col("pos1").cast("long").alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")) for df, a, b in ((one, 1, 0), (other, 0, 1))]
    ends = [df.select("chr", (F.col("pos2").cast("long") + 1).alias("p"), F.lit(-a).alias("a"), F.lit(-b).alias("b")) for df, a, b in ((one, 1, 0), (other, 0, 1))]
    events = functools.reduce(DataFrame.unionByName, starts + ends)
    kept = swept(events, "a", "b").where("a > 0 and b = 0").select("chr", F.col("p").cast("int").alias("pos1"), (F.col("q") - 1).cast("int").alias("pos2"))
    return merged_at_scale(kept, touching=True)


def merged(df: DataFrame, keys: list[str] | None = None, touching: bool = False) -> DataFrame:
    """Overlapping intervals of each key as one; a shared end point merges, adjacent ones only if ``touching``. Strand is no matter."""
    keys = keys or ["chr"]
    order = Window.partitionBy(*keys).orderBy("pos1", "pos2")
    before = F.max("pos2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("pos1") > before + (1 if touching else 0)), 1).otherwise(0)
    islands = df.select(*keys, "pos1", "pos2", fresh.alias("fresh")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("pos1").alias("pos1"), F.max("pos2").alias("pos2")).drop("island")


def merged_at_scale(df: DataFrame, bits: int = 24, touching: bool = False) -> DataFrame:
    """``merged`` by chromosome for tables too large for one task per chromosome.

    Intervals are merged within the block of 2 ** bits positions where they start. Blocks then learn, from one row each, how far what
    began before them reaches and how many islands did; an interval within that reach belongs to the last of those.
    """
    islands = merged(df.withColumn("block", F.shiftright(F.col("pos1"), bits)), ["chr", "block"], touching)
    by_block, before = Window.partitionBy("chr").orderBy("block"), (Window.unboundedPreceding, -1)
    reach = islands.groupBy("chr", "block").agg(F.max("pos2").alias("end"))
    reach = reach.select("chr", "block", F.max("end").over(by_block.rowsBetween(*before)).alias("reach"))
    fresh = F.when(F.col("reach").isNull() | (F.col("pos1") > F.col("reach") + (1 if touching else 0)), 1).otherwise(0)
    marked = islands.join(reach, ["chr", "block"]).select("chr", "block", "pos1", "pos2", fresh.alias("fresh"))
    counts = marked.groupBy("chr", "block").agg(F.sum("fresh").alias("n"))
    counts = counts.select("chr", "block", F.coalesce(F.sum("n").over(by_block.rowsBetween(*before)), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("chr", "block").orderBy("pos1").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.join(counts, ["chr", "block"]).withColumn("island", F.col("earlier") + F.sum("fresh").over(inside))
    return numbered.groupBy("chr", "island").agg(F.min("pos1").alias("pos1"), F.max("pos2").alias("pos2")).drop("island")


def concatenated(*tables: DataFrame) -> DataFrame:
    """UNION ALL."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union(*tables: DataFrame) -> DataFrame:
    return merged_at_scale(concatenated(*[t.select("chr", "pos1", "pos2") for t in tables]))


def total_width(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col("pos2").cast("long") - F.col("pos1") + 1), F.lit(0)).cast("long").alias("total_width"))


def summary(df: DataFrame) -> DataFrame:
    """Size and number of chromosomes."""
    return df.agg(F.count("*").alias("size"), F.count_distinct("chr").alias("chromosomes"))


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """The first and last ``n`` regions in coordinate order."""
    key = [F.col(c) for c in ("chr", "pos1", "pos2", "id")]
    return df.orderBy(*key).limit(n).unionByName(df.orderBy(*[k.desc() for k in key]).limit(n))


def coordinate_sorted(df: DataFrame) -> DataFrame:
    return df.orderBy("chr", "pos1", "pos2")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def _beside(df: DataFrame, column: str, following: bool, per_chr: bool) -> DataFrame:
    """``df`` with ``column`` of the next or the previous row, by chr, pos1, pos2 and id, as ``__beside``; null at the end.

    Rows look within their block of positions, and blocks, of one row each, over their borders.
    """
    order = F.struct("pos1", "pos2", "id")
    rows = df.withColumn("__block", F.shiftright(F.col("pos1"), SWEEP_BITS))
    edge = (F.min_by if following else F.max_by)(column, order).alias("__edge")
    blocks = rows.groupBy("chr", "__block").agg(edge)
    beside = F.lead if following else F.lag
    over = (Window.partitionBy("chr") if per_chr else Window.partitionBy(F.lit(1))).orderBy("chr", "__block")
    blocks = blocks.select("chr", "__block", beside("__edge").over(over).alias("__over"))
    inside = Window.partitionBy("chr", "__block").orderBy("pos1", "pos2", "id")
    found = rows.join(blocks, ["chr", "__block"]).withColumn("__beside", F.coalesce(beside(column).over(inside), F.col("__over")))
    return found.select(*df.columns, "__beside")


def stretched_right(df: DataFrame, top: int = 0, per_chr: bool = False) -> DataFrame:
    """Each end moved to just before the next start, over chromosome borders unless ``per_chr``; the last end becomes ``top`` if above 0.

    A ``top`` below the last end is an error.
    """
    following = F.col("__beside")
    last = F.when((F.lit(top) > 0) & (F.col("pos2") > top), F.raise_error(F.lit("the last region ends beyond the limit")).cast("int")).otherwise(F.lit(top) if top > 0 else F.col("pos2"))
    return _beside(df, "pos1", True, per_chr).withColumn("pos2", F.when(following.isNotNull(), following - 1).otherwise(last).cast("int")).drop("__beside")


def stretched_left(df: DataFrame, bottom: int = -1, per_chr: bool = False) -> DataFrame:
    """Each start moved to just after the end before it; the first start becomes ``bottom`` if that is 0 or more. Above it is an error."""
    before = F.col("__beside")
    first = F.when((F.lit(bottom) >= 0) & (F.col("pos1") < bottom), F.raise_error(F.lit("the first region starts before the limit")).cast("int")).otherwise(F.lit(bottom) if bottom >= 0 else F.col("pos1"))
    return _beside(df, "pos2", False, per_chr).withColumn("pos1", F.when(before.isNotNull(), before + 1).otherwise(first).cast("int")).drop("__beside")


def padded(df: DataFrame, pad: int) -> DataFrame:
    from genospark.functions import region as R

    start, end = R.padded(pad)
    return df.withColumns({"pos1": start, "pos2": end})


def tiles(df: DataFrame, width: int, overlap: int) -> DataFrame:
    """Closed tiles [s, s + width] of each region, ``width - overlap`` apart, with a shorter last one; the region itself if it is no wider."""
    if width <= overlap:
        raise ValueError("tiles must be wider than their overlap")
    step, long = width - overlap, F.col("pos2") - F.col("pos1") > width
    starts = F.when(long, F.sequence(F.col("pos1"), F.greatest(F.col("pos2") - width, F.col("pos1")), F.lit(step))).otherwise(F.array("pos1"))
    cut = df.withColumn("starts", starts)
    last = F.element_at("starts", -1) + width
    tail = F.when(long & (last < F.col("pos2")), F.array(F.struct((last - overlap).alias("pos1"), F.col("pos2").alias("pos2"))))
    full = F.transform("starts", lambda s: F.struct(s.alias("pos1"), F.least(s + width, F.col("pos2")).alias("pos2")))
    rows = cut.withColumn("tile", F.explode(F.concat(full, F.coalesce(tail, F.array().cast("array<struct<pos1:int,pos2:int>>")))))
    return rows.select("id", "chr", F.col("tile.pos1").cast("int").alias("pos1"), F.col("tile.pos2").cast("int").alias("pos2"))


def genome_tiles(dictionary: DataFrame, width: int, overlap: int) -> DataFrame:
    """Closed tiles [s, s + width] over [0, length] of each chromosome, without a last partial one; a shorter chromosome is one tile."""
    if width <= overlap:
        raise ValueError("tiles must be wider than their overlap")
    length = F.col("length").cast("int")
    starts = F.when(length > width, F.sequence(F.lit(0), F.greatest(length - width, F.lit(0)), F.lit(width - overlap))).otherwise(F.array(F.lit(0)))
    tiled = dictionary.select(F.col("id").alias("chr"), length.alias("length"), F.explode(starts).alias("pos1"))
    return tiled.select("chr", F.col("pos1").cast("int").alias("pos1"), F.least(F.col("pos1") + width, F.col("length")).cast("int").alias("pos2"))


def depth_runs(df: DataFrame, inclusive_end: bool = False, coalesce: bool = False) -> DataFrame:
    """Runs (chr, start, end, depth) of equal depth above 0, end exclusive, of half-open intervals chr, start, end.

    An event sweep: never a row per position. ``inclusive_end`` counts the end position too. ``coalesce`` joins adjacent runs of one
    depth, as bedgraph output asks for.
    """
    end = F.col("end") + 1 if inclusive_end else F.col("end")
    events = df.select("chr", F.col("start").cast("long").alias("p"), F.lit(1).alias("v")).unionByName(df.select("chr", end.cast("long").alias("p"), F.lit(-1).alias("v")))
    if coalesce:  # a position where as many begin as end is no border
        events = events.groupBy("chr", "p").agg(F.sum("v").alias("v")).where("v <> 0")
    runs = swept(events, "v").where("v > 0")
    return runs.select("chr", F.col("p").cast("int").alias("start"), F.col("q").cast("int").alias("end"), F.col("v").cast("long").alias("depth"))


def read_spans(reads: DataFrame, trim: int = 0, full_length: bool = False) -> DataFrame:
    """Half-open spans (chr, start, end) of reads for ``depth_runs``: trimmed at both ends, or widened over soft clips; none below 0."""
    from genospark.functions import flags as A
    from genospark.functions import sequence as S

    start = S.position_with_soft_clips() if full_length else F.col("pos")
    end = S.position_end_with_soft_clips(A.position_end()) if full_length else A.position_end()
    spans = reads.select(F.col("tid").alias("chr"), F.greatest(start + trim, F.lit(0)).alias("start"), (end - trim).alias("end"))
    return spans.where("chr >= 0 and start < end")


def max_depth(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))


def depth_at(runs: DataFrame, points: DataFrame) -> DataFrame:
    """The depth at each point (id, chr, pos); 0 where nothing covers it."""
    at = pairs(points.select("id", "chr", F.col("pos").alias("pos1"), F.col("pos").alias("pos2")), runs.select("chr", F.col("start").alias("pos1"), (F.col("end") - 1).alias("pos2"), "depth"))
    hit = at.select(F.col("q.id").alias("i"), F.col("s.depth").alias("d"))
    return points.join(hit, F.col("id") == F.col("i"), "left").select("id", "chr", "pos", F.coalesce("d", F.lit(0)).cast("long").alias("depth"))


def bedgraph(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Text lines name, start, end, depth."""
    joined = runs.join(names.select(F.col("id").alias("chr"), "name"), "chr", "left")
    name = F.coalesce("name", F.col("chr").cast("string"))
    return joined.select(F.concat_ws("\t", name, F.col("start").cast("string"), F.col("end").cast("string"), F.col("depth").cast("string")).alias("line"))


#: Positions to a block of merged regions that reads look up: at most 512 islands.
REACH_BITS = 10


def overlapping_reads(reads: DataFrame, regions: DataFrame, mate_linked: bool = False, anti: bool = False) -> DataFrame:
    """Reads that overlap any region, each row once; or those that overlap none. ``mate_linked``: or whose mate does.

    A read's exclusive end is taken as closed; a linked mate spans its start plus the own length. A read meets the row of the block where
    it ends, which holds the merged regions that begin there and how far those before it reach: no pair is made, and no read comes twice.
    """
    from genospark.functions import flags as A

    out = reads.withColumns({"__e0": A.position_end(), "__e1": A.mate_position_end()})
    islands = merged_at_scale(regions.select("chr", "pos1", "pos2")).withColumn("block", F.shiftright("pos1", REACH_BITS))
    begun = islands.groupBy("chr", "block").agg(F.collect_list(F.struct("pos1", "pos2")).alias("islands"), F.max("pos2").alias("e"))
    by_block = Window.partitionBy("chr").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = F.lit(False)
    for k, (chrom, start) in enumerate([("tid", "pos"), ("mtid", "mpos")][: 2 if mate_linked else 1]):
        ends = out.select(F.col(chrom).alias("chr"), F.shiftright(f"__e{k}", REACH_BITS).alias("block")).distinct()
        known = ends.select("*", F.lit(None).cast("int").alias("e")).unionByName(begun.select("chr", "block", F.col("e").cast("int").alias("e")))
        known = known.groupBy("chr", "block").agg(F.max("e").alias("e")).select("chr", "block", F.max("e").over(by_block).alias("before"))
        rows = known.join(begun.drop("e"), ["chr", "block"], "left").select(F.col("chr").alias(f"__c{k}"), F.col("block").alias(f"__b{k}"), F.col("before").alias(f"__r{k}"), F.col("islands").alias(f"__i{k}"))
        out = out.join(rows, (F.col(chrom) == F.col(f"__c{k}")) & (F.shiftright(f"__e{k}", REACH_BITS) == F.col(f"__b{k}")), "left")
        inside = F.exists(f"__i{k}", lambda i: (i["pos1"] <= F.col(f"__e{k}")) & (i["pos2"] >= F.col(start)))  # noqa: B023
        found = found | F.coalesce(F.col(f"__r{k}") >= F.col(start), F.lit(False)) | F.coalesce(inside, F.lit(False))
    return out.where(~found if anti else found).select(*reads.columns)


def scan_regions(reads: DataFrame, regions: DataFrame, distinct: bool = False) -> DataFrame:
    """Reads by region in the regions' order: a read that k regions hit comes k times, with region_id. ``distinct``: each row that any
    region hits once; equal rows all stay."""
    from genospark.functions import flags as A

    if distinct:
        return overlapping_reads(reads, regions)

    spans = reads.withColumns({"__p1": F.col("pos"), "__p2": A.position_end()})
    found = pairs(spans, regions, ("tid", "__p1", "__p2")).select(F.col("s.id").alias("region_id"), "q.*").drop("__p1", "__p2")
    return found


def sampled_by_regions(reads: DataFrame, fractions: DataFrame, seed: int = 999) -> DataFrame:
    """A subsample by name whose rate depends on place: the largest ``frac`` of the regions a read overlaps, none elsewhere.

    ``fractions`` has chr, pos1, pos2 and frac. The rate depends on the coordinates alone, so distinct ones are joined with the regions.
    """
    from genospark.functions import flags as A
    from genospark.functions.hashing import keep_fraction

    out = reads.withColumn("__e", A.position_end())
    spans = out.select(F.col("tid").alias("chr"), F.col("pos").alias("pos1"), F.col("__e").alias("pos2")).distinct()
    rates = pairs(spans, fractions).groupBy(F.col("q.chr").alias("__c"), F.col("q.pos1").alias("__s"), F.col("q.pos2").alias("__t")).agg(F.max("s.frac").alias("__f"))
    rated = out.join(rates, (F.col("tid") == F.col("__c")) & (F.col("pos") == F.col("__s")) & (F.col("__e") == F.col("__t")))
    return rated.where(keep_fraction(F.col("qname"), F.col("__f"), seed)).select(*reads.columns)

"""CIGAR strings as Column expressions. Letters that are no operation are skipped when parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATION = r"([0-9]+)([MIDNSHP=X])"
#: Which operations move along the read, and along the reference.
QUERY, REFERENCE, ALIGNED = "MIS=X", "MDN=X", "MID=X"


def _of(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def lengths(kinds: str, cigar: Column | str = "cigar") -> Column:
    """The lengths of the operations of these kinds, as array<int>."""
    return F.transform(F.regexp_extract_all(_of(cigar), F.lit(rf"([0-9]+)[{kinds}]"), F.lit(1)), lambda x: x.cast("int"))


def total(kinds: str, cigar: Column | str = "cigar") -> Column:
    return F.aggregate(lengths(kinds, cigar), F.lit(0), lambda a, x: a + x)


def parsed(cigar: Column | str = "cigar") -> Column:
    """array<struct<op, len>>, in order."""
    column = _of(cigar)
    kinds, sizes = F.regexp_extract_all(column, F.lit(OPERATION), F.lit(2)), F.regexp_extract_all(column, F.lit(OPERATION), F.lit(1))
    return F.zip_with(kinds, sizes, lambda k, n: F.struct(k.alias("op"), n.cast("int").alias("len")))


def printed(operations: Column) -> Column:
    return F.array_join(F.transform(operations, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def reversed_string(cigar: Column | str = "cigar") -> Column:
    return printed(F.reverse(parsed(cigar)))


def operations(cigar: Column | str = "cigar") -> Column:
    return F.size(parsed(cigar))


def valid(cigar: Column | str = "cigar") -> Column:
    return _of(cigar).rlike(r"^([0-9]+[MIDNSHP=XB])+$")


def query_consumed(cigar: Column | str = "cigar") -> Column:
    return total(QUERY, cigar)


def reference_consumed(cigar: Column | str = "cigar") -> Column:
    return total(REFERENCE, cigar)


def aligned_bases(cigar: Column | str = "cigar") -> Column:
    return total(ALIGNED, cigar)


def match_bases(cigar: Column | str = "cigar") -> Column:
    return total("M", cigar)


def longest(kind: str, cigar: Column | str = "cigar") -> Column:
    """The longest operation of a kind, such as the largest insertion; 0 without one."""
    return F.coalesce(F.array_max(lengths(kind, cigar)), F.lit(0))


def soft_clip(cigar: Column | str = "cigar") -> Column:
    return total("S", cigar)


def hard_clip(cigar: Column | str = "cigar") -> Column:
    return total("H", cigar)


def clip(cigar: Column | str = "cigar") -> Column:
    return total("SH", cigar)


def _leading_soft(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"^(?:[0-9]+H)*([0-9]+)S", 1).try_cast("int"), F.lit(0))


def _clips(cigar: Column, at_end: bool) -> Column:
    run = F.regexp_extract(cigar, r"((?:[0-9]+[SH])*)$" if at_end else r"^((?:[0-9]+[SH])*)", 1)
    return F.aggregate(F.transform(F.regexp_extract_all(run, F.lit(r"([0-9]+)[SH]"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)


def alignment_start(cigar: Column | str = "cigar") -> Column:
    """Soft-clipped bases before the aligned part of the read; hard clips do not count."""
    return _leading_soft(_of(cigar))


def alignment_end(length: Column | str = "l_qseq", cigar: Column | str = "cigar") -> Column:
    """Read length less the clips at the end; hard clips are taken off too, though the length leaves them out."""
    return (_of(length) - _clips(_of(cigar), True)).cast("int")


def alignment_start_reverse(cigar: Column | str = "cigar") -> Column:
    """Clips before the aligned part as seen from the other strand."""
    return _clips(_of(cigar), True).cast("int")


def alignment_end_reverse(length: Column | str = "l_qseq", cigar: Column | str = "cigar") -> Column:
    return (_of(length) - _leading_soft(_of(cigar))).cast("int")


def match_blocks(cigar: Column | str = "cigar") -> Column:
    """array<struct<start, end>> of query offsets in M operations, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, o: Column) -> Column:
        end = state["at"] + o["len"]
        block = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(
            F.when(o["op"].isin(*QUERY), end).otherwise(state["at"]).alias("at"),
            F.when(o["op"] == "M", F.concat(state["out"], block)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(parsed(cigar), start, step, lambda s: s["out"])


def overlapping_coverage(one: Column, other: Column) -> Column:
    """Query offsets that are M in both CIGARs, from the overlaps of their blocks."""
    both = lambda a, b: F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    blocks = match_blocks(other)
    per_block = F.transform(match_blocks(one), lambda a: F.aggregate(F.transform(blocks, lambda b: both(a, b)), F.lit(0), lambda s, x: s + x))
    return F.aggregate(per_block, F.lit(0), lambda s, x: s + x)

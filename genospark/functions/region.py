"""Closed genomic intervals as Column expressions over chr, pos1, pos2, strand (with an optional column suffix)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(suffix: str = "") -> Column:
    return (F.col(f"pos2{suffix}").cast("long") - F.col(f"pos1{suffix}") + 1).cast("long")


def overlap_class(one: str = "", other: str = "_b") -> Column:
    """3: the first lies inside the second (or equals it); 2: the second inside the first; 1: partial; 0: none. Strand is no matter."""
    a1, a2, b1, b2 = (F.col(n) for n in (f"pos1{one}", f"pos2{one}", f"pos1{other}", f"pos2{other}"))
    same = F.col(f"chr{one}") == F.col(f"chr{other}")
    return F.when(~same | (a2 < b1) | (b2 < a1), 0).when((a1 >= b1) & (a2 <= b2), 3).when((b1 >= a1) & (b2 <= a2), 2).otherwise(1).cast("int")


def overlaps(chrom: int, pos1: int, pos2: int) -> Column:
    return (F.col("chr") == chrom) & (F.col("pos1") <= pos2) & (F.col("pos2") >= pos1)


def distance_starts(one: str = "", other: str = "_b") -> Column:
    """-1 across chromosomes."""
    return F.when(F.col(f"chr{one}") == F.col(f"chr{other}"), F.abs(F.col(f"pos1{one}") - F.col(f"pos1{other}"))).otherwise(-1).cast("int")


def distance_ends(one: str = "", other: str = "_b") -> Column:
    return F.when(F.col(f"chr{one}") == F.col(f"chr{other}"), F.abs(F.col(f"pos2{one}") - F.col(f"pos2{other}"))).otherwise(-1).cast("int")


def key(suffix: str = "") -> Column:
    """What regions are compared and sorted by; strand is no part of it."""
    return F.struct(*[F.col(f"{c}{suffix}").alias(c) for c in ("chr", "pos1", "pos2")])


def padded(pad: Column | int) -> tuple[Column, Column]:
    """pos1 and pos2 moved apart by ``pad``; shrinking by more than the width is an error. Starts may become negative."""
    pad = F.lit(pad) if isinstance(pad, int) else pad
    too_far = -2 * pad > width()
    start = F.when(too_far, F.raise_error(F.lit("pad shrinks a region below nothing")).cast("int")).otherwise(F.col("pos1") - pad)
    return start.cast("int"), (F.col("pos2") + pad).cast("int")


def is_empty() -> Column:
    return (F.col("chr") == -1) & (F.col("pos1") == 0) & (F.col("pos2") == 0)


def checked() -> Column:
    """True for a valid region, an error for one whose end lies before its start or whose strand is unknown."""
    bad = (F.col("pos2") < F.col("pos1")) | ~F.col("strand").isin("+", "-", "*")
    return F.when(bad, F.raise_error(F.lit("not a region")).cast("boolean")).otherwise(True)


def default_name(chrom: str = "chr") -> Column:
    """Name without a dictionary: X, Y and M for 22, 23 and 24; numbers count from 1; negatives stay."""
    c = F.col(chrom)
    return F.when(c < 0, c.cast("string")).when(c == 22, "X").when(c == 23, "Y").when(c == 24, "M").otherwise((c + 1).cast("string"))


def to_string(name: Column) -> Column:
    """name:1,000-2,000(+)."""
    return F.concat(name, F.lit(":"), F.format_number("pos1", 0), F.lit("-"), F.format_number("pos2", 0), F.lit("("), F.col("strand"), F.lit(")"))


def point_string(name: Column) -> Column:
    """name:1,000(+), the start alone."""
    return F.concat(name, F.lit(":"), F.format_number("pos1", 0), F.lit("("), F.col("strand"), F.lit(")"))


def chromosome_id(name: Column) -> Column:
    """Id of a name without a dictionary: X 22, Y 23, else the number after any 'chr', less one; null if it is none."""
    bare = F.replace(name, F.lit("chr"))
    return F.when(bare == "X", 22).when(bare == "Y", 23).when(bare == "M", 24).otherwise(bare.try_cast("int") - 1).cast("int")


def bed_line(name: Column) -> Column:
    return F.concat_ws("\t", name, F.col("pos1").cast("string"), F.col("pos2").cast("string"), F.col("strand"))

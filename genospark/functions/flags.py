"""Record flags and scalars of alignment records, as Column expressions over the READ schema. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genospark.functions import cigar as C

#: The flag bits of the alignment format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
FIRST, LAST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
FR, FF, RF, RR, UNDEFINED = range(5)


def bit(mask: int) -> Column:
    return F.col("flag").bitwiseAND(mask) != 0


def reverse() -> Column:
    return bit(REVERSE)


def mate_reverse() -> Column:
    return bit(MATE_REVERSE)


def paired() -> Column:
    return bit(PAIRED)


def proper_pair() -> Column:
    return bit(PROPER)


def mapped() -> Column:
    return ~bit(UNMAPPED)


def mate_mapped() -> Column:
    return ~bit(MATE_UNMAPPED)


def pair_mapped() -> Column:
    """Paired, and both mates mapped."""
    return F.col("flag").bitwiseAND(PAIRED | UNMAPPED | MATE_UNMAPPED) == PAIRED


def first_in_pair() -> Column:
    return bit(FIRST)


def last_in_pair() -> Column:
    return bit(LAST)


def secondary() -> Column:
    return bit(SECONDARY)


def qc_fail() -> Column:
    return bit(QC_FAIL)


def duplicate() -> Column:
    return bit(DUPLICATE)


def supplementary() -> Column:
    return bit(SUPPLEMENTARY)


def interchromosomal() -> Column:
    return (F.col("tid") != F.col("mtid")) & pair_mapped()


def pair_orientation() -> Column:
    """0 FR, 1 FF, 2 RF, 3 RR, 4 undefined. The leftmost mate comes first, this read on a tie; the paired bit itself is not asked for."""
    own_first = (F.col("tid") < F.col("mtid")) | ((F.col("tid") == F.col("mtid")) & (F.col("pos") <= F.col("mpos")))
    left, right = F.when(own_first, reverse()).otherwise(mate_reverse()), F.when(own_first, mate_reverse()).otherwise(reverse())
    both = mapped() & mate_mapped()
    known = F.when(~left & right, FR).when(~left & ~right, FF).when(left & ~right, RF).otherwise(RR)
    return F.when(both, known).otherwise(UNDEFINED).cast("int")


def proper_orientation() -> Column:
    """One chromosome, and the mate further left on the forward strand with the other on the reverse strand."""
    forward = F.when(F.col("pos") < F.col("mpos"), ~reverse() & mate_reverse()).otherwise(reverse() & ~mate_reverse())
    return (F.col("tid") == F.col("mtid")) & forward


def position_end() -> Column:
    """Exclusive end on the reference; one past the start where the read is unmapped or has no CIGAR."""
    placed = mapped() & F.col("cigar").isNotNull() & ~F.col("cigar").isin("", "*")
    return (F.col("pos") + F.when(placed, F.greatest(C.reference_consumed(), F.lit(1))).otherwise(1)).cast("int")


def mate_position_end() -> Column:
    """Mate start plus this read's own query length: the mate's is not known."""
    return (F.col("mpos") + F.col("l_qseq")).cast("int")


def full_insert_size() -> Column:
    """Distance of the starts plus query bases consumed, for pairs mapped to one chromosome; else 0."""
    near = pair_mapped() & (F.col("tid") == F.col("mtid"))
    return F.when(near, F.abs(F.col("pos") - F.col("mpos")) + C.query_consumed()).otherwise(0).cast("int")


def read_group() -> Column:
    """The RG tag, else what stands before the first colon of the name, else 'NA'."""
    return F.coalesce(F.col("rg"), F.when(F.instr("qname", ":") > 0, F.substring_index("qname", ":", 1)), F.lit("NA"))


def region() -> Column:
    """The read as a region; its exclusive end is taken as closed. Strand '*' where unmapped."""
    strand = F.when(~mapped(), "*").when(reverse(), "-").otherwise("+")
    return F.struct(F.col("tid").alias("chr"), F.col("pos").alias("pos1"), position_end().alias("pos2"), strand.alias("strand"))


def mate_region() -> Column:
    strand = F.when(~mate_mapped(), "*").when(mate_reverse(), "-").otherwise("+")
    return F.struct(F.col("mtid").alias("chr"), F.col("mpos").alias("pos1"), mate_position_end().alias("pos2"), strand.alias("strand"))


def _brief(chrom: str, pos: str, is_reverse: Column) -> Column:
    return F.concat((F.col(chrom) + 1).cast("string"), F.lit(":"), F.format_number(pos, 0), F.lit("("), F.when(is_reverse, "-").otherwise("+"), F.lit(")"))


def brief() -> Column:
    return _brief("tid", "pos", reverse())


def mate_brief() -> Column:
    return _brief("mtid", "mpos", mate_reverse())


def percent_kept(kept: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 where there is nothing."""
    return F.when(total > 0, F.floor(kept * 100 / total)).otherwise(0).cast("int")


def with_flag(mask: int, on: Column | bool = True) -> Column:
    """The flag with the bits of ``mask`` set or cleared."""
    flag, on = F.col("flag"), F.lit(on) if isinstance(on, bool) else on
    return F.when(on, flag.bitwiseOR(mask)).otherwise(flag.bitwiseAND(~mask)).cast("int")


def sam_lite() -> Column:
    """Eleven tab-separated fields; chromosomes count from 1 and qualities are left out."""
    text = lambda c: F.col(c).cast("string")
    isize = F.coalesce(F.col("isize"), F.lit(0))
    fields = [F.col("qname"), text("flag"), (F.col("tid") + 1).cast("string"), text("pos"), text("mapq"), F.col("cigar"), (F.col("mtid") + 1).cast("string"), text("mpos"), isize.cast("string"), F.col("seq"), F.lit("*")]
    return F.concat_ws("\t", *fields)


def built(name: Column, seq: Column, cigar: Column, chrom: Column, pos1: Column, pos2: Column, strand: Column) -> Column:
    """A record made by hand, as struct<qname, flag, tid, pos, mapq, cigar, seq, l_qseq>: mapped at pos1, mapq 60, reverse if '-'.

    An unknown operation, a CIGAR that does not use the bases of the sequence, or one that does not span the closed region is an error.
    """
    bad = (
        F.when(~C.valid(cigar), "not a CIGAR").when(C.query_consumed(cigar) != F.length(seq), "the CIGAR does not fit the sequence")
        .when(C.reference_consumed(cigar) != pos2 - pos1 + 1, "the CIGAR does not fit the region")
    )
    checked = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(name)
    fields = {"qname": checked, "flag": F.when(strand == "-", REVERSE).otherwise(0).cast("int"), "tid": chrom, "pos": pos1, "mapq": F.lit(60), "cigar": cigar, "seq": F.regexp_replace(seq, "[^ACGT]", "N"), "l_qseq": F.length(seq)}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def is_missing() -> Column:
    """Whether a row holds no record."""
    return F.col("qname").isNull()


def position_key(mate: bool = False) -> Column:
    """What records are compared and sorted by: (tid, pos), or the mate's."""
    return F.struct("mtid", "mpos") if mate else F.struct("tid", "pos")


def cleared() -> dict[str, Column]:
    """Columns for ``withColumns`` that empty sequence, qualities and tags."""
    tags = F.lit(None).cast("map<string,struct<type:string,value:string>>")
    return {"seq": F.lit(None).cast("string"), "qual": F.lit(None).cast("string"), "tags": tags}


def with_qualities(qual: Column) -> Column:
    """The qualities, checked against the sequence's length; an empty string removes them."""
    wrong = (qual != "") & (F.length(qual) != F.length("seq"))
    return F.when(wrong, F.raise_error(F.lit("qualities do not fit the sequence")).cast("string")).when(qual != "", qual)

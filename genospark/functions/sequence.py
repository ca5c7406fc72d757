"""Bases, qualities, names and tags, as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from genospark.functions import cigar as C


def _of(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def reverse_complement(seq: Column | str) -> Column:
    """Case is kept; what is not one of ACGTN becomes a blank."""
    known = F.regexp_replace(_of(seq), "[^ACGTNacgtn]", " ")
    return F.reverse(F.translate(known, "ACGTacgt", "TGCAtgca"))


def n_bases(seq: Column | str = "seq") -> Column:
    return (F.length(_of(seq)) - F.length(F.replace(_of(seq), F.lit("N")))).cast("int")


def encoded_bases(seq: Column | str = "seq") -> Column:
    """What is stored of a sequence: all but ACGT become N."""
    return F.regexp_replace(_of(seq), "[^ACGT]", "N")


def phred(qual: Column | str = "qual", offset: int = 33) -> Column:
    """Qualities as array<int>."""
    return F.transform(F.filter(F.split(_of(qual), ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def qualities(qual: Column | str = "qual", offset: int = 33) -> Column:
    """The quality string at another offset than 33."""
    return F.array_join(F.transform(phred(qual), lambda q: F.char(q + offset)), "")


def quality_trim(threshold: int, qual: Column | str = "qual", length: Column | str = "l_qseq") -> Column:
    """struct<start, end>: first base of at least this quality, and one past the last. None: (length, -1); no qualities: (0, -1)."""
    column = _of(qual)
    low = "".join(rf"\x{c:02x}" for c in range(33, 33 + max(0, threshold)))
    left = F.length(F.regexp_replace(column, f"^[{low}]+", "")) if low else F.length(column)
    right = F.length(F.regexp_replace(column, f"[{low}]+$", "")) if low else F.length(column)
    start = F.when(column.isNull(), 0).when(left == 0, _of(length)).otherwise(F.length(column) - left)
    end = F.when(column.isNull() | (left == 0), -1).otherwise(right)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _mean_codes(quals):
    """Mean of the letters' codes less 33 of an Arrow array of strings, 0 for empty ones and nulls: from the bytes where all are one byte long."""
    if pa.types.is_large_string(quals.type):
        width = np.int64
    else:
        quals, width = quals.cast(pa.string()), np.int32
    _, offsets, data = quals.buffers()
    size = len(quals)
    ends = np.frombuffer(offsets, width)[quals.offset : quals.offset + size + 1].astype(np.int64) if size and offsets is not None else np.zeros(size + 1, np.int64)
    codes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(codes) and codes.max() > 127:
        rows = [q or "" for q in quals.to_pylist()]
        return pa.array([sum(ord(c) - 33 for c in q) / len(q) if q else 0.0 for q in rows], pa.float64())
    sums = np.concatenate([[0], np.cumsum(codes, dtype=np.int64)])[ends - ends[0]]
    lengths = np.diff(ends)
    found = (np.diff(sums) - 33 * lengths) / np.maximum(lengths, 1)
    known = quals.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(np.where((lengths > 0) & known, found, 0.0), pa.float64())


def mean_phred(qual: Column | str = "qual") -> Column:
    @F.arrow_udf("double")
    def mean(quals: pa.Array) -> pa.Array:
        return _mean_codes(quals)

    return mean(_of(qual))


def commas(number: Column | str) -> Column:
    return F.format_number(_of(number), 0)


def scrub(text: Column | str, part: str) -> Column:
    """All occurrences of ``part`` removed, again and again until none is left (up to 16 times)."""
    out = _of(text)
    if not part:
        return out
    for _ in range(1 if len(set(part)) == len(part) and len(part) < 2 else 16):
        out = F.replace(out, F.lit(part))
    return out


def position_with_soft_clips() -> Column:
    return (F.col("pos") - C.alignment_start()).cast("int")


def position_end_with_soft_clips(end: Column) -> Column:
    return (end + F.coalesce(F.regexp_extract("cigar", r"([0-9]+)S(?:[0-9]+H)*$", 1).try_cast("int"), F.lit(0))).cast("int")


def list_count(value: Column) -> Column:
    """Entries of a tag value that ends each entry with a semicolon, such as secondary or chimeric alignments; 0 where null."""
    return F.coalesce(F.length(value) - F.length(F.replace(value, F.lit(";"))), F.lit(0)).cast("int")


def tag(name: str, tags: Column | str = "tags") -> Column:
    """Any tag as text: Z as it is, integers plain, floats with six decimals; null where missing."""
    entry = _of(tags)[name]
    return F.when(entry["type"].isin("f", "d"), F.format_string("%.6f", entry["value"].try_cast("double"))).otherwise(entry["value"])


def z_tag(name: str, tags: Column | str = "tags") -> Column:
    entry = _of(tags)[name]
    return F.when(entry["type"] == "Z", entry["value"])


def int_tag(name: str, tags: Column | str = "tags") -> Column:
    entry = _of(tags)[name]
    return F.when(entry["type"].isin(*"icCsSI"), entry["value"].try_cast("int"))


def float_tag(name: str, tags: Column | str = "tags") -> Column:
    entry = _of(tags)[name]
    return F.when(entry["type"].isin("f", "d"), entry["value"].try_cast("double"))


def multi_tag(name: str, kind: str = "string", tags: Column | str = "tags") -> Column:
    """A ^-delimited Z tag as an array of ``kind``."""
    return F.transform(F.split(z_tag(name, tags), r"\^"), lambda x: x.try_cast(kind))


def without_tag(*names: str, tags: Column | str = "tags") -> Column:
    return F.map_filter(_of(tags), lambda k, _: ~k.isin(*names))


def with_tag(name: str, kind: str, value: Column, tags: Column | str = "tags") -> Column:
    """The tags with one set; an empty name, or a null or empty value, changes nothing."""
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    base = F.coalesce(_of(tags), empty)
    text = value.cast("string")
    if not name:
        return base
    added = F.map_concat(F.map_filter(base, lambda k, _: k != name), F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), text.alias("value"))))
    return F.when(text.isNull() | (text == ""), base).otherwise(added)


def fastq() -> Column:
    """Four lines of a sequence: name and comment, bases, plus, qualities."""
    head = F.concat(F.lit("@"), F.col("name"), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" "), F.col("comment"))).otherwise(""))
    return F.concat_ws("\n", head, F.col("seq"), F.lit("+"), F.coalesce("qual", F.lit("")))

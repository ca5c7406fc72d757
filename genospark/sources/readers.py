"""Readers of the common file formats. Text formats go through Spark's own reader, so they split, decompress and work on any store;
so does BAM, cut at its compressed blocks."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospark.functions import cigar as C
from genospark.functions import region as R
from genospark.operators import dictionary as D
from genospark.schema import READ, REGION
from genospark.sources import bam_splits

_INTEGERS = "c C s S i I".split()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, qual (null), strand ('*') of each record; sequences may span lines, files may be compressed."""
    lines = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace("r", r"^[^\n]*\n?", "")
    parsed = lines.select(record.alias("r")).where("trim(r) <> ''").select(head.alias("h"), F.regexp_replace(body, r"\s", "").alias("seq"))
    name = F.regexp_extract("h", r"^(\S*)", 1)
    return parsed.select(name.alias("name"), F.trim(F.regexp_replace("h", r"^\S*", "")).alias("comment"), "seq", F.lit(None).cast("string").alias("qual"), F.lit("*").alias("strand"))


def read_fastq(spark: SparkSession, path: str, number: bool = False) -> DataFrame:
    """name, comment, seq, qual, strand ('*') of four-line records, split like any text, in files that may be compressed (by extension).

    Files are cut before each line that begins with '@'. Four lines are a record. Where a quality line begins with '@', its record comes as
    a head of three lines and a tail of one: only these are shuffled, ordered within their split, and paired; a head that ends a split meets
    the tail that begins the file's next one. The text is scanned once for whole records and once for such pairs. A record cut short at
    the end of a file goes; names do not begin with '@'. ``number``: also ``id``, another for each record and the same in every scan of the
    same splits, however the shuffle deals rows out.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    pieces = spark.read.option("lineSep", "\n@").text(path).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("p"), *place)
    get = lambda k: F.get("p", F.lit(k))
    whole = pieces.where(F.size("p") >= 4).select("at", get(0).alias("head"), get(1).alias("seq"), get(3).alias("qual"))

    is_head = F.size("p") == 3
    parts = pieces.where((F.size("p") <= 2) | (is_head & get(2).startswith("+")))
    in_split = Window.partitionBy("file", "block").orderBy("at")
    met = parts.select("*", is_head.alias("is_head"), F.lead(get(0)).over(in_split).alias("tail"), F.lag("at").over(in_split).isNull().alias("first"))
    # at most one tail and one head of each split are left over; all else keeps a window of its own
    border = F.when(F.col("is_head") & F.col("tail").isNull() | ~F.col("is_head") & F.col("first"), F.lit(-1)).otherwise(F.col("at"))
    met = met.where(F.col("is_head") | F.col("first")).withColumn("border", border)
    over = Window.partitionBy("file", "border").orderBy("block", "at")
    met = met.select("p", "at", "is_head", F.coalesce("tail", F.lead(F.when(~F.col("is_head"), get(0))).over(over)).alias("tail"))
    paired = met.where("is_head and tail is not null").select("at", get(0).alias("head"), get(1).alias("seq"), F.concat(F.lit("@"), "tail").alias("qual"))

    name = F.substring_index("h", " ", 1)
    records = whole.unionByName(paired).select(F.regexp_replace("head", "^@", "").alias("h"), "seq", "qual", F.col("at").alias("id"))
    return records.select(name.alias("name"), F.expr("substring(h, length(substring_index(h, ' ', 1)) + 2)").alias("comment"), "seq", "qual", F.lit("*").alias("strand"), *(["id"] if number else []))


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.monotonically_increasing_id()).select(*REGION.names)


def read_bed(spark: SparkSession, path: str, dictionary: DataFrame, fraction: bool = False) -> DataFrame:
    """Regions of a BED file, columns verbatim. Lines with '#', track and browser lines, unknown chromosomes, and rows that are no region go.

    ``fraction``: the fourth column as a double ``frac``.
    """
    lines = spark.read.text(path).where(~F.col("value").contains("#") & ~F.col("value").rlike("^(track|browser)"))
    parts = F.split(F.trim(F.regexp_replace("value", "\r", "")), r"\s+")
    get = lambda k: F.get(parts, F.lit(k))
    rows = lines.select(get(0).alias("name"), get(1).try_cast("int").alias("pos1"), get(2).try_cast("int").alias("pos2"), get(3).try_cast("double").alias("frac"))
    rows = D.with_id(rows.where("pos1 is not null and pos2 is not null and pos2 >= pos1"), dictionary, "name", "chr", True).where("chr >= 0")
    rows = rows.withColumns({"strand": F.lit("*"), "id": F.monotonically_increasing_id()})
    return rows.select(*REGION.names, *(["frac"] if fraction else []))


def read_vcf(spark: SparkSession, path: str, dictionary: DataFrame) -> DataFrame:
    """Regions of width 1 of a VCF file's sites. Rows whose position is no number, and unknown chromosomes, go."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", r"\s+")
    rows = lines.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast("int").alias("pos1")).where("pos1 is not null")
    rows = D.with_id(rows, dictionary, "name", "chr", True).where("chr >= 0")
    return _numbered(rows.withColumns({"pos2": F.col("pos1"), "strand": F.lit("*")}))


def parse_region(text: str, entries: list[tuple[int, str, int]]) -> tuple[int, int, int]:
    """name:1,000-2,000, name:1,000 (to the chromosome's end) or a bare name, as closed 1-based (chr, pos1, pos2)."""
    if not entries:
        raise ValueError("a region string needs a dictionary")
    name, _, span = text.rpartition(":") if re.search(r":[0-9,]+(-[0-9,]*)?$", text) else (text, "", "")
    found = next(((i, n) for i, k, n in entries if k == name), None)
    if found is None:
        raise ValueError(f"unknown reference sequence: {name!r}")
    low, _, high = span.replace(",", "").partition("-")
    region = found[0], int(low) if low else 1, int(high) if high else found[1]
    if region[2] < region[1]:
        raise ValueError(f"not a region: {text!r}")
    return region


def regions(spark: SparkSession, source: str, dictionary: DataFrame) -> DataFrame:
    """A region string, or a file: .vcf is VCF, all else BED."""
    looks_like_file = re.search(r"\.(bed|vcf)(\.gz)?$", source)
    if not looks_like_file and ":" in source and "://" not in source:
        entries = [(r["id"], r["name"], r["length"]) for r in dictionary.collect()]  # one row per reference sequence
        return spark.createDataFrame([(0, *parse_region(source, entries), "*")], REGION)
    return read_vcf(spark, source, dictionary) if ".vcf" in source else read_bed(spark, source, dictionary)


def regions_of_reads(reads: DataFrame) -> DataFrame:
    from genospark.functions import flags as A

    return _numbered(reads.select(F.col("tid").alias("chr"), F.col("pos").alias("pos1"), A.position_end().alias("pos2"), F.lit("*").alias("strand")))


def region_table(spark: SparkSession, rows: list[tuple[int, int, int, str]]) -> DataFrame:
    """Regions (chr, pos1, pos2, strand) as a table; an end before its start or an unknown strand is an error."""
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REGION)
    return made.where(R.checked())


def read_motifs(spark: SparkSession, path: str) -> list[str]:
    """One word a line. A dictionary is meant to fit on the driver."""
    return [r[0] for r in spark.read.text(path).where("trim(value) <> ''").select(F.trim("value")).collect()]


def sam_header(spark: SparkSession, path: str) -> str:
    """The @ lines of a SAM file."""
    head = spark.read.text(path).where(F.col("value").rlike("^@[A-Z][A-Z]\t")).withColumn("n", F.monotonically_increasing_id())
    return "".join(r["value"] + "\n" for r in head.orderBy("n").collect())


def sam_reads(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Alignment lines (value) as READ rows: positions become 0-based, '*' and '=' are resolved, tags are a map."""
    f = lambda k: F.get("f", F.lit(k))
    rows = lines.where(~F.col("value").rlike("^@[A-Z][A-Z]\t") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    star = lambda k: F.when(f(k) != "*", f(k))
    tags = F.expr("map_from_entries(transform(slice(f, 12, greatest(size(f) - 11, 0)), t -> struct(substring(t, 1, 2), struct(substring(t, 4, 1) as type, substring(t, 6) as value))))")
    flat = rows.select(
        f(0).alias("qname"), f(1).cast("int").alias("flag"), f(2).alias("rname"), (f(3).cast("int") - 1).alias("pos"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"),
        F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("mname"), (f(7).cast("int") - 1).alias("mpos"), f(8).cast("int").alias("isize"), star(9).alias("seq"), star(10).alias("qual"), tags.alias("tags"),
    )
    placed = D.with_id(D.with_id(flat, dictionary, "rname", "tid"), dictionary, "mname", "mtid")
    length = F.coalesce(F.length("seq"), C.query_consumed()).cast("int")
    done = placed.withColumns({"l_qseq": length, "rg": F.col("tags")["RG"]["value"], "nm": F.col("tags")["NM"]["value"].try_cast("int")})
    return done.select(*[F.col(x.name).cast(x.dataType).alias(x.name) for x in READ.fields])


def read_sam(spark: SparkSession, path: str, dictionary: DataFrame | None = None) -> DataFrame:
    dictionary = D.from_text(spark, sam_header(spark, path)) if dictionary is None else dictionary
    return sam_reads(spark.read.text(path), dictionary)


def read_merged(spark: SparkSession, paths: list[str], dictionary: DataFrame) -> DataFrame:
    """Several SAM files as one table in coordinate order; naming a file twice is an error."""
    if len(set(paths)) != len(paths):
        raise ValueError("a file is named twice")
    return sam_reads(spark.read.text(paths), dictionary).orderBy("tid", "pos")


# --- BAM ---

_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZE = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def bam_dictionary(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, (name, length) entries, and where the records begin, of uncompressed BAM bytes."""
    if data[:4] != b"BAM\1"[: len(data)] or not data:
        raise ValueError("not a BAM file")
    (n,) = struct.unpack_from("<i", data, 4)
    (refs,) = struct.unpack_from("<i", data, 8 + n)  # fails where the header text is cut short
    text, at = data[8 : 8 + n].rstrip(b"\0").decode("utf-8"), 8 + n
    at, entries = at + 4, []
    for _ in range(refs):
        (n,) = struct.unpack_from("<i", data, at)
        name = data[at + 4 : at + 3 + n].decode()
        (length,) = struct.unpack_from("<i", data, at + 4 + n)
        entries.append((name, length))
        at += 8 + n
    return text, entries, at


def _bam_tags(data: bytes, at: int, end: int) -> dict[str, dict[str, str]]:
    tags = {}
    while at < end:
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            value, at = data[at:stop].decode(), stop + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_SIZE[sub]}", data, at + 5)
            value, at = sub + "".join(f",{v}" for v in values), at + 5 + n * struct.calcsize(_SIZE[sub])
        else:
            (raw,) = struct.unpack_from("<" + _SIZE[kind], data, at)
            value, at = raw.decode() if kind == "A" else f"{raw:g}" if kind == "f" else str(raw), at + struct.calcsize(_SIZE[kind])
        tags[key] = {"type": "i" if kind in _INTEGERS else kind, "value": value}
    return tags


def bam_rows(data: bytes) -> Iterator[tuple]:
    """READ tuples of uncompressed BAM bytes."""
    yield from bam_records(data, bam_dictionary(data)[2])


def bam_records(data: bytes, at: int) -> Iterator[tuple]:
    """READ tuples of the records that begin at ``at``."""
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, isize = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        p = at + 36
        name = data[p : p + l_name - 1].decode()
        p += l_name
        cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, p)) or "*"
        p += 4 * n_cigar
        packed = data[p : p + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        p += len(packed)
        quals = data[p : p + l_seq]
        tags = _bam_tags(data, p + l_seq, at + 4 + size)
        rg, nm = tags.get("RG", {}).get("value"), tags.get("NM", {}).get("value")
        qual = None if not quals or quals[0] == 255 else "".join(chr(q + 33) for q in quals)
        yield name, flag, tid, pos, mapq, cigar, mtid, mpos, isize, l_seq, seq or None, qual, rg, None if nm is None else int(nm), tags
        at += 4 + size


def read_bam(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """READ rows of BAM files, which are split like text. ``whole_files``: one task a file of at most 2 GB, for files that hold no blocks."""
    if not whole_files:
        return bam_splits.read_splits(spark, path, READ, bam_dictionary, bam_records)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for row in bam_rows(gzip.decompress(content)):
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=READ.names).astype({"nm": "Int32"})
                        rows = []
                yield pd.DataFrame(rows, columns=READ.names).astype({"nm": "Int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, READ)


def _bam_head(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and entries of the first file at ``path``, from as many bytes of its beginning as they take."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(root)
    if status.isDirectory():
        status = min((x for x in files.listStatus(root) if not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getPath().getName())
    stream, data, packer = files.open(status.getPath()), b"", zlib.decompressobj(31)
    try:
        while True:
            raw = bytes(stream.readNBytes(1 << 16))
            ended = not raw
            while raw:
                data += packer.decompress(raw)
                raw = packer.unused_data
                packer = zlib.decompressobj(31) if packer.eof else packer
            try:
                return bam_dictionary(data)[:2]
            except struct.error:
                if ended:
                    raise ValueError("not a BAM file") from None
    finally:
        stream.close()


def bam_header_text(spark: SparkSession, path: str) -> str:
    return _bam_head(spark, path)[0]


def read_bam_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return D.from_pairs(spark, _bam_head(spark, path)[1])


# --- reference genome ---


def reference_chunks(genome: DataFrame, size: int = 1 << 16) -> DataFrame:
    """A FASTA table as (name, chunk, seq) rows of bounded size, for genome-scale look-ups."""
    cut = genome.select("name", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))).alias("start"))
    return cut.select("name", (F.col("start") / size).cast("int").alias("chunk"), F.substring("seq", F.col("start") + 1, F.lit(size)).alias("seq"))


def reference_query(chunks: DataFrame, queries: DataFrame, size: int = 1 << 16) -> DataFrame:
    """The bases of closed 0-based queries (id, name, pos1, pos2), cut from chunks; errors for pos1 > pos2 or pos1 < 0, null if unknown."""
    bad = (F.col("pos1") > F.col("pos2")) | (F.col("pos1") < 0)
    asked = queries.withColumn("pos1", F.when(bad, F.raise_error(F.lit("not a reference interval")).cast("int")).otherwise(F.col("pos1")))
    wanted = asked.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("pos1") / size).cast("int"), F.floor(F.col("pos2") / size).cast("int"))))
    met = wanted.join(chunks, ["name", "chunk"])
    low = F.greatest(F.col("pos1") - F.col("chunk") * size, F.lit(0))
    high = F.least(F.col("pos2") - F.col("chunk") * size, F.lit(size - 1))
    pieces = met.select("id", "chunk", F.substring("seq", low + 1, high - low + 1).alias("part"))
    joined = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("bases"))
    return queries.join(joined, "id", "left").select("id", "name", "pos1", "pos2", F.when(F.col("bases") != "", F.col("bases")).alias("bases"))

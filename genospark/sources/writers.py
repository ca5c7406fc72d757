"""Writers and text forms. Text goes through Spark's own writer; BAM through a data source of this package."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from genospark.functions import region as R
from genospark.operators import dictionary as D
from genospark.schema import READ
from genospark.sources import readers


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """A one-column table of lines as text files; an existing target is refused."""
    df.write.mode(mode).options(**options).text(path)


def bed_lines(regions: DataFrame, dictionary: DataFrame) -> DataFrame:
    return D.with_region_name(regions, dictionary, "__name").select(R.bed_line(F.col("__name")).alias("line"))


def fasta_lines(sequences: DataFrame) -> DataFrame:
    head = F.concat(F.lit(">"), F.col("name"), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" "), F.col("comment"))).otherwise(""))
    return sequences.select(F.concat(head, F.lit("\n"), F.col("seq")).alias("line"))


def sam_lines(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Full SAM lines: 1-based positions, names, qualities and tags."""
    named = D.with_name(D.with_name(reads, dictionary, "tid", "__r"), dictionary, "mtid", "__m")
    star = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "*").otherwise(c)
    mate = F.when((F.col("mtid") >= 0) & (F.col("mtid") == F.col("tid")), "=").otherwise(star(F.col("__m")))
    text = lambda c: c.cast("string")
    tags = F.expr("transform(array_sort(map_entries(tags)), e -> concat(e.key, ':', e.value.type, ':', e.value.value))")
    fixed = [F.col("qname"), text(F.col("flag")), star(F.col("__r")), text(F.col("pos") + 1), text(F.col("mapq")), star(F.col("cigar")), mate, text(F.col("mpos") + 1), text(F.coalesce("isize", F.lit(0))), star(F.col("seq")), star(F.col("qual"))]
    return named.select(F.concat_ws("\t", *fixed, tags).alias("line"))


def write_sam(reads: DataFrame, dictionary: DataFrame, path: str, header: str | None = None) -> None:
    """SAM text: the header as a file of its own name that sorts first, records beside it."""
    text = header if header is not None else "@HD\tVN:1.6\n" + D.header_text(dictionary)
    sam_lines(reads, dictionary).write.mode("errorifexists").text(path)
    reads.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("append").text(path)


def write_indexed(reads: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet ranged and sorted by (tid, pos): min-max statistics of files and row groups stand in for a positional index."""
    ranged = reads.repartitionByRange(partitions, "tid", "pos") if partitions else reads.repartitionByRange("tid", "pos")
    ranged.sortWithinPartitions("tid", "pos").write.mode("errorifexists").parquet(path)


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """GFA1 lines (kind, line): segments (id, name, seq, reads, depth) and links (source, target, reversed flags, overlap,
    and source_name and target_name where ids are not the names), each link once."""
    spark = segments.sparkSession
    head = spark.createDataFrame([(0, "H\tVN:Z:1.0")], "kind int, line string")
    text = lambda c: F.col(c).cast("string")
    s = segments.select(F.lit(1).alias("kind"), F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("LN:i:"), F.length("seq").cast("string")), F.concat(F.lit("RC:i:"), text("reads")), F.concat(F.lit("PD:Z:"), text("depth"))).alias("line"))
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    once = links.where("source < target")
    one, other = [f"{c}_name" if f"{c}_name" in links.columns else c for c in ("source", "target")]
    link = once.select(F.lit(2).alias("kind"), F.concat_ws("\t", F.lit("L"), text(one), sign("source_reverse"), text(other), sign("target_reverse"), F.concat(text("overlap"), F.lit("M"))).alias("line"))
    return head.unionByName(s).unionByName(link)


def assembled_gfa_lines(assembled: DataFrame, overlap: int) -> DataFrame:
    """``gfa_lines`` of the graph tables of an assembly, which is made once: a row's segment and links come from it together."""
    head = assembled.sparkSession.createDataFrame([(0, "H\tVN:Z:1.0")], "kind int, line string")
    segment = F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("LN:i:"), F.length("seq").cast("string")), F.concat(F.lit("RC:i:"), F.col("reads").cast("string")), F.concat(F.lit("PD:Z:"), F.col("depth").cast("string")))
    once = F.filter("links", lambda x: F.col("id") < x["target"])
    sign = lambda c: F.when(c, "-").otherwise("+")
    named = lambda i: F.concat_ws(":", "group", i.cast("string"))
    link = lambda x: F.concat_ws("\t", F.lit("L"), named(F.col("id")), sign(x["source_reverse"]), named(x["target"]), sign(x["target_reverse"]), F.lit(f"{overlap}M"))
    lines = F.concat(F.array(F.struct(F.lit(1).alias("kind"), segment.alias("line"))), F.transform(once, lambda x: F.struct(F.lit(2).alias("kind"), link(x).alias("line"))))
    return head.unionByName(assembled.select(F.explode(lines).alias("l")).select("l.kind", "l.line"))


# --- BAM ---

_CODES = {b: i for i, b in enumerate("=ACMGRSVTWYHKDBN")}
_OPS = {o: i for i, o in enumerate("MIDNSHP=X")}
_EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf(data: bytes) -> Iterator[bytes]:
    """Blocks of the blocked compression of the BAM format."""
    for at in range(0, len(data), 65_280):
        part = data[at : at + 65_280]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        yield head + body + struct.pack("<II", zlib.crc32(part), len(part))


def bam_header(text: str, entries: list[tuple[str, int]]) -> bytes:
    data = text.encode()
    out = b"BAM\1" + struct.pack("<i", len(data)) + data + struct.pack("<i", len(entries))
    for name, length in entries:
        raw = name.encode() + b"\0"
        out += struct.pack("<i", len(raw)) + raw + struct.pack("<i", length)
    return out


def _bin(start: int, end: int) -> int:
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


def bam_record(row) -> bytes:
    import re

    operations = [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = row["seq"] or ""
    codes = [_CODES.get(b.upper(), 15) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    quals = bytes(ord(q) - 33 for q in row["qual"]) if row["qual"] else b"\xff" * len(seq)
    tags = dict(row["tags"] or {})
    if row["rg"] is not None and "RG" not in tags:
        tags["RG"] = {"type": "Z", "value": row["rg"]}
    if row["nm"] is not None and "NM" not in tags:
        tags["NM"] = {"type": "i", "value": str(row["nm"])}
    extra = b""
    for key, tag in tags.items():
        kind, value = tag["type"], tag["value"]
        if kind in "iIcCsS":
            extra += key.encode() + b"i" + struct.pack("<i", int(value))
        elif kind == "f":
            extra += key.encode() + b"f" + struct.pack("<f", float(value))
        elif kind == "A":
            extra += key.encode() + b"A" + value.encode()[:1]
        elif kind in "ZH":
            extra += key.encode() + kind.encode() + value.encode() + b"\0"
    name = (row["qname"] or "*").encode() + b"\0"
    width = sum(n for n, o in operations if o in "MDN=X") or 1
    pos = -1 if row["pos"] is None else row["pos"]
    body = struct.pack("<iiBBHHHiiii", row["tid"], pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + width), len(operations), row["flag"], len(seq), row["mtid"], row["mpos"], row["isize"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | _OPS[o]) for n, o in operations) + packed + quals + extra
    return struct.pack("<i", len(body)) + body


@dataclass
class _Written(WriterCommitMessage):
    path: str


class BamDataSource(DataSource):
    """format("genospark-bam"): BAM files in a mounted folder, one per task when writing, one partition per file when reading."""

    @classmethod
    def name(cls) -> str:
        return "genospark-bam"

    def schema(self):
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options["path"], self.options.get("header", ""))


class _BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        names = [os.path.join(self.path, n) for n in sorted(os.listdir(self.path)) if n.endswith(".bam")] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(n) for n in names]

    def read(self, partition):
        import gzip

        with open(partition.value, "rb") as file:
            yield from readers.bam_rows(gzip.decompress(file.read()))


class _BamWriter(DataSourceWriter):
    def __init__(self, path: str, header: str):
        self.path, self.header = path, header
        if os.path.isdir(path) and os.listdir(path):
            raise ValueError(f"{path} exists")

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        entries = [(f["SN"], int(f["LN"])) for f in (dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in self.header.splitlines() if line.startswith("@SQ"))]
        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, f"part-{uuid.uuid4().hex}.bam")
        with open(target + ".open", "wb") as file:
            pending = bam_header(self.header, entries)
            for row in iterator:
                pending += bam_record(row.asDict(recursive=True))
                if len(pending) > 1 << 20:
                    cut = len(pending) - len(pending) % 65_280
                    file.writelines(bgzf(pending[:cut]))
                    pending = pending[cut:]
            file.writelines(bgzf(pending))
            file.write(_EMPTY_BLOCK)
        return _Written(target)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.path + ".open", m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path + ".open"):
                os.remove(m.path + ".open")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamDataSource)


def write_bam(reads: DataFrame, dictionary: DataFrame, path: str) -> None:
    """BAM files, one per partition, each with the header. CRAM has no codec here and is refused by name."""
    if path.endswith(".cram"):
        raise ValueError("CRAM is not supported")
    register(reads.sparkSession)
    columns = [F.col(n) if n in reads.columns else F.lit(None).cast(READ[n].dataType).alias(n) for n in READ.names]
    reads.select(*columns).write.format("genospark-bam").option("header", "@HD\tVN:1.6\n" + D.header_text(dictionary)).mode("append").save(path)

"""BAM files read by splits.

A file is cut at the four bytes that begin each of its compressed blocks, by Spark's own text reader, so it splits like any text and on any
store. Blocks give their own length: a piece that is too short has been cut at the same bytes inside a block and takes the next one on.
Records know no separator. The first one of a split is found by what a record's fields allow, over a chain of records; what lies before
it and after the last whole record is a border. Borders of neighbouring splits are put together and must be whole records, to the byte, up
to the place where the next split found its first one: as the first split begins at the header, a place found wrongly is always noticed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"\x1f\x8b\x08\x04"
LOOK = 1 << 20  # bytes among which a split's first record is looked for first; more are taken where it is not there
CHAIN = 64  # records that must follow one another for a first one to be believed, or all up to the end
ROWS = 20_000
_BORDER = "file string, block long, start boolean, lead binary, head binary, tail binary, rest binary"

Records = Callable[[bytes, int], Iterator[tuple]]
Header = Callable[[bytes], tuple]


def block_size(raw: bytes) -> int | None:
    """Length of the compressed block at the start of ``raw``; None where that is none, or too little of it to tell."""
    if len(raw) < 18 or raw[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", raw, 10)[0]
    while at + 6 <= min(end, len(raw)):
        if raw[at : at + 4] == b"BC\2\0":
            return struct.unpack_from("<H", raw, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", raw, at + 2)[0]
    return None


def _inflated(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def record_end(data: bytes, at: int) -> int | None:
    """Where the record at ``at`` ends by its own account; 0 where the bytes are no record, None where too few are there to tell."""
    if at + 36 > len(data):
        return None
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if min(tid, pos, mtid, mpos) < -1 or l_seq < 0 or l_name < 1 or size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) < l_name:
        return None
    if name[-1] or any(not 33 <= b <= 126 for b in name[:-1]) or any(b & 15 > 8 for b in data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar : 4]):
        return 0
    return at + 4 + size


def first_record(data: bytes) -> int | None:
    """The first place from which records follow one another as far as ``data`` or CHAIN goes; at least one must be whole."""
    for start in range(max(0, len(data) - 35)):
        at, n, end = start, 0, record_end(data, start)
        while end and end <= len(data) and n < CHAIN:
            at, n = end, n + 1
            end = record_end(data, at)
        if n and end != 0:
            return start
    return None


@dataclass
class Split:
    """One split of a file, from its pieces to inflated bytes: whole records come from ``runs``, all else is left in the fields."""

    block: int
    header: Header
    start: bool = False
    lead: bytes = b""  # compressed, before the first block that begins here
    head: bytes = b""  # inflated, before the first record
    tail: bytes = b""  # inflated, after the last whole record
    rest: bytes = b""  # compressed, of a block that is not complete

    def _find(self, data: bytes) -> int | None:
        if self.block:
            return first_record(data)
        try:
            return self.header(data)[2]
        except struct.error:  # the header goes on
            return None

    def runs(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        begun, data, goal = self.block == 0, b"", LOOK
        for k, piece in enumerate(pieces):
            if self.block == 0 and k == 0:
                if piece:
                    raise ValueError("not a BAM file")
                continue
            raw = MAGIC + piece
            if not begun and block_size(raw) is None:
                self.lead += raw
                continue
            begun = True
            self.rest += raw
            size = block_size(self.rest)
            if size is None or len(self.rest) < size:
                if len(self.rest) > 1 << 17:
                    raise ValueError("not a block of a BAM file")
                continue
            if len(self.rest) > size:
                raise ValueError("not a block of a BAM file")
            data, self.rest = data + _inflated(self.rest), b""
            if not self.start and len(data) >= goal:
                data, goal = self._begin(data), 2 * goal
            if self.start:
                yield from self._whole(data)
                data = self.tail
        if not self.start and data:
            data = self._begin(data)
        if self.start:
            yield from self._whole(data)
        else:
            self.head = data

    def _begin(self, data: bytes) -> bytes:
        found = self._find(data)
        if found is None:
            return data
        self.start, self.head = True, data[:found] if self.block else b""
        return data[found:]

    def _whole(self, data: bytes) -> Iterator[bytes]:
        at = 0
        while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
            if size < 32:
                raise ValueError("not a record of a BAM file")
            at += 4 + size
        self.tail = data[at:]
        if at:
            yield data[:at]


def _splits(batches: Iterator[pd.DataFrame], header: Header) -> Iterator[tuple[str, Split, Iterator[bytes]]]:
    rows = (row for batch in batches for row in zip(batch["file"], batch["block"], batch["raw"]))
    for (file, block), pieces in groupby(rows, key=lambda r: (r[0], r[1])):
        yield file, Split(int(block), header), (bytes(p[2]) for p in pieces)


def joined(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """The inflated bytes of borders in order; each is (end of a block, inflated bytes, beginning of a block)."""
    data, rest = [], b""
    for before, inflated, after in entries:
        rest += before
        while (size := block_size(rest)) is not None and size <= len(rest):
            data.append(_inflated(rest[:size]))
            rest = rest[size:]
        if inflated and rest:
            raise ValueError("not a block of a BAM file")
        data.append(inflated)
        rest += after
    if rest:
        raise ValueError("a BAM file is cut short")
    return b"".join(data)


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pd.DataFrame(held, columns=names).astype({"nm": "Int32"})
            held = []
    if held:
        yield pd.DataFrame(held, columns=names).astype({"nm": "Int32"})


def read_splits(spark: SparkSession, path: str, schema: T.StructType, header: Header, records: Records) -> DataFrame:
    """Rows of ``records`` of all files at ``path``. Two scans: one parses whole records, one only inflates, for the borders."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    text = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = text.select(F.col("value").cast("binary").alias("raw"), *place)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames((row for _, split, raw in _splits(batches, header) for run in split.runs(raw) for row in records(run, 0)), schema.names)

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _BORDER.split(", ")]
        for file, split, raw in _splits(batches, header):
            for _ in split.runs(raw):
                pass
            yield pd.DataFrame([(file, split.block, split.start, split.lead, split.head, split.tail, split.rest)], columns=names)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for chain, parts in zip(batch["chain"], batch["parts"]):
                    data = joined([(bytes(p["before"]), bytes(p["inflated"]), bytes(p["after"])) for p in parts])
                    if not data:
                        continue
                    at = end = header(data)[2] if chain == 0 else 0
                    while end < len(data):
                        if end + 4 > len(data) or (size := struct.unpack_from("<i", data, end)[0]) < 32 or end + 4 + size > len(data):
                            raise ValueError("a split of a BAM file does not begin where its records do, or the file is cut short: read it with whole_files=True")
                        end += 4 + size
                    yield from records(data, at)

        yield from _frames(rows(), schema.names)

    # a chain is the tail of a split with a first record, all splits without one behind it, and the head of the next one that has one
    number = F.sum(F.col("start").cast("long")).over(Window.partitionBy("file").orderBy("block"))
    none = F.lit(b"")
    found = pieces.mapInPandas(borders, _BORDER).withColumn("n", number)
    heads = F.struct((F.col("n") - F.col("start").cast("long")).alias("chain"), F.col("lead").alias("before"), F.col("head").alias("inflated"), F.when(F.col("start"), none).otherwise(F.col("rest")).alias("after"))
    tails = F.struct(F.col("n").alias("chain"), none.alias("before"), F.col("tail").alias("inflated"), F.when(F.col("start"), F.col("rest")).otherwise(none).alias("after"))
    entries = found.select("file", "block", F.explode(F.when(F.col("start"), F.array(heads, tails)).otherwise(F.array(heads))).alias("e")).select("file", "block", "e.*")
    entries = entries.where((F.length("before") > 0) | (F.length("inflated") > 0) | (F.length("after") > 0))
    chains = entries.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "before", "inflated", "after"))).alias("parts"))
    return pieces.mapInPandas(inside, schema).unionByName(chains.select("chain", "parts").mapInPandas(between, schema))

"""k-mer counts, their spectrum and the coverage it tells."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from genospark.functions.sequence import reverse_complement


def kmers(df: DataFrame, k: int, seq: str = "seq", canonical: bool = False) -> DataFrame:
    """A row (kmer) per k-mer without N. Positions are exploded, so no array of k-mers is built.

    ``canonical``: the smaller of a k-mer and its reverse complement, which is cut from the reverse complement of the whole sequence.
    """
    strands = [F.col(seq).alias("seq")] + ([reverse_complement(seq).alias("other")] if canonical else [])
    places = df.where(F.length(seq) >= k).select(*strands).select("*", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("at"))
    kmer = F.substring("seq", F.col("at"), F.lit(k))
    found = places.where(F.instr(kmer, "N") == 0)
    return found.select((F.least(kmer, F.substring("other", F.length("seq") - k + 2 - F.col("at"), F.lit(k))) if canonical else kmer).alias("kmer"))


def kmer_counts(df: DataFrame, k: int, seq: str = "seq", canonical: bool = False) -> DataFrame:
    return kmers(df, k, seq, canonical).groupBy("kmer").agg(F.count("*").alias("n"))


#: Letters that are packed at once.
CHUNK = 1 << 20
_LETTERS = np.full(256, 5, np.uint8)
_LETTERS[list(b"ACGTN\n")] = [0, 1, 2, 3, 4, 4]
_DIGITS = str.maketrans("ACGT", "0123")


class _Turned(dict):
    """What ``reverse_complement`` makes of a letter: a blank of an unknown one."""

    def __missing__(self, code: int) -> str:
        return " "


_TURNED = _Turned(str.maketrans("ACGTNacgtn", "TGCANtgcan"))


def _windows(letters: np.ndarray, k: int) -> np.ndarray:
    """All runs of k letters as numbers, two bits a letter: runs of twice the length from pairs of runs."""
    part, size, width, out = letters.astype(np.uint64), 1, 0, None
    while True:
        if k & size:
            n = len(letters) - width - size + 1
            out = part[:n] if out is None else out[:n] << np.uint64(2 * size) | part[width : width + n]
            width += size
        if 2 * size > k:
            return out
        part, size = part[:-size] << np.uint64(2 * size) | part[size:], 2 * size


def _flipped(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed k-mers."""
    out = ~codes
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        out = out >> np.uint64(bits) & np.uint64(mask) | (out & np.uint64(mask)) << np.uint64(bits)
    return out.byteswap() >> np.uint64(64 - 2 * k)


def _as_bytes(codes: np.ndarray, k: int) -> pa.Array:
    size = (k + 3) // 4
    data = np.ascontiguousarray(codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :])
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(data)])


def _spelled(text: str, k: int) -> Iterator[tuple[int, bytes]]:
    """Place and canonical form of each k-mer without N, one at a time: packed if it has no letters but ACGT, else its text, which is longer."""
    for at in range(len(text) - k + 1):
        kmer = text[at : at + k]
        if "N" in kmer:
            continue
        kmer = min(kmer, kmer.translate(_TURNED)[::-1])
        if k > 31 or set(kmer) - set("ACGT"):
            yield at, kmer.encode()
        else:
            yield at, int(kmer.translate(_DIGITS), 4).to_bytes((k + 3) // 4, "big")


def _cut(texts: list[str | None], k: int) -> Iterator[list[tuple[int, int, str]]]:
    """Row, place and text of pieces that hold each k-mer once, in lists of about CHUNK letters."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or "") - k + 1, CHUNK):
            pieces.append((row, at, text[at : at + CHUNK + k - 1]))
            size += len(pieces[-1][2]) + 1
            if size >= CHUNK:
                yield pieces
                pieces, size = [], 0
    if pieces:
        yield pieces


def _packed_chunk(pieces: list[tuple[int, int, str]], k: int):
    """Packed k-mers, their rows and places; then row, place and bytes of those in pieces with other letters."""
    text = "\n".join(p[2] for p in pieces)
    odd = []
    if k > 31 or not text.isascii() or text.count("\n") >= len(pieces) or (_LETTERS[np.frombuffer(text.encode(), np.uint8)] == 5).any():
        plain = []
        for row, at, piece in pieces:
            if k > 31 or set(piece) - set("ACGTN"):
                odd += [(row, at + i, kmer) for i, kmer in _spelled(piece, k)]
            else:
                plain.append((row, at, piece))
        pieces, text = plain, "\n".join(p[2] for p in plain)
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), odd
    letters = _LETTERS[np.frombuffer(text.encode(), np.uint8)]
    bad = np.concatenate([[0], np.cumsum(letters == 4, dtype=np.int32)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    codes = _windows(letters & 3, k)[at]
    sizes = np.array([len(p[2]) + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), sizes)[at]
    places = at - (np.cumsum(sizes) - sizes)[piece] + np.array([p[1] for p in pieces])[piece]
    return np.minimum(codes, _flipped(codes, k)), np.array([p[0] for p in pieces])[piece], places, odd


def packed_places(df: DataFrame, k: int, *columns: str, seq: str = "seq") -> DataFrame:
    """A row per k-mer without N: ``columns``, its place ``at`` from 0 and its canonical form ``kmer`` in bytes. Up to k 31, four bases of ACGT take
    a byte; k-mers with other letters, and longer ones, are texts. Long sequences are cut, so no array holds all k-mers of one."""
    schema = StructType([df.schema[c] for c in columns]).add("at", IntegerType()).add("kmer", BinaryType())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _cut(batch.column(0).to_pylist(), k):
                codes, rows, places, odd = _packed_chunk(pieces, k)
                if odd:
                    rows, places = np.concatenate([rows, [o[0] for o in odd]]), np.concatenate([places, [o[1] for o in odd]])
                kmer = pa.concat_arrays([_as_bytes(codes, k), pa.array([o[2] for o in odd], pa.binary())])
                taken = [batch.column(1 + n).take(pa.array(rows, pa.int64())) for n in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(places, pa.int32()), kmer], names=[*columns, "at", "kmer"])

    return df.select(F.col(seq).alias("__seq"), *columns).mapInArrow(found, schema)


def packed_counts(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``kmer_counts`` of the forms of ``packed_places``. Each piece of the input is counted before it is sent, so a k-mer that is everywhere
    makes few rows, and no worker holds more of the table than a piece until then."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces in _cut(batch.column(0).to_pylist(), k):
                codes, _, _, odd = _packed_chunk(pieces, k)
                codes, n = np.unique(codes, return_counts=True)
                more = Counter(o[2] for o in odd)
                kmer = pa.concat_arrays([_as_bytes(codes, k), pa.array(list(more), pa.binary())])
                yield pa.RecordBatch.from_arrays([kmer, pa.array([*n.tolist(), *more.values()], pa.int64())], names=["kmer", "n"])

    pieces = df.select(F.col(seq)).mapInArrow(found, StructType().add("kmer", BinaryType()).add("n", LongType()))
    # rows are small: were partitions joined up to Spark's usual bytes, a task would hold millions of k-mers
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "kmer").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_spectrum(counts: DataFrame) -> DataFrame:
    """How many k-mers occur n times; counts above 255 are taken as 255."""
    return counts.select(F.least("n", F.lit(255)).cast("int").alias("n")).groupBy("n").agg(F.count("*").alias("kmers"))


def kmer_coverage(spectrum: DataFrame, min_count: int = 3, max_count: int = 255, coefficient: float = 0.1) -> DataFrame:
    """kcov: mean count of the k-mers seen at least ``min_count`` times; min_cov: its clamped share, the count from which one is solid."""
    kept = spectrum.where(F.col("n") >= min_count)
    mean = kept.agg(F.coalesce(F.sum(F.col("n") * F.col("kmers")) / F.sum("kmers"), F.lit(0.0)).alias("kcov"))
    solid = F.greatest(F.lit(min_count), F.least(F.lit(max_count), F.floor(F.col("kcov") * coefficient + 0.499).cast("int")))
    return mean.select("kcov", solid.cast("int").alias("min_cov"))


def auto_k(df: DataFrame, seq: str = "seq") -> int:
    """An odd k from the total of bases: about log2 of it, between 11 and 31."""
    total = df.agg(F.coalesce(F.sum(F.length(seq)), F.lit(0))).first()[0]
    k = max(11, min(31, int(total).bit_length()))
    return k if k % 2 else k + 1 if k < 31 else 31


def prefix_length(total_bases: int) -> int:
    """Bits by which a count table of so many bases is split."""
    return max(0, min(total_bases - 8, 20))

"""Text plots of reads in a view: gapped sequences packed first-fit onto lines. A view is small, and filtered before anything is gathered."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.functions import flags as A


def gapped(seq: str, cigar: str) -> str:
    """Matched bases, '-' for each deleted one; insertions are left out. Starts after leading soft clips."""
    clip = re.match(r"(?:\d+H)*(\d+)S", cigar)
    at, out = int(clip[1]) if clip else 0, ""
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op == "M":
            out += seq[at : at + n]
        elif op == "D":
            out += "-" * n
        if op in "MI":
            at += n
    return out


def gapped_sequence(seq: Column | str, cigar: Column | str) -> Column:
    """``gapped`` as a column: pieces of the sequence by the operations of the CIGAR."""
    seq, cigar = (F.col(c) if isinstance(c, str) else c for c in (seq, cigar))
    cuts = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDS])"), 1), lambda t: F.struct(F.substring(t, 1, F.length(t) - 1).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    piece = lambda a, x: F.when(x["op"] == "M", F.substring(seq, a["at"], x["n"])).when(x["op"] == "D", F.repeat(F.lit("-"), x["n"])).otherwise("")
    moved = lambda a, x: (a["at"] + F.when(x["op"].isin("M", "I", "S"), x["n"]).otherwise(0)).cast("int")
    return F.aggregate(cuts, start, lambda a, x: F.struct(moved(a, x).alias("at"), F.concat(a["out"], piece(a, x)).alias("out")))["out"]


def packed_lines(reads: list[tuple[int, str, str]], width: int, pad: int = 5) -> list[str]:
    """(position, sequence, note) entries by position, each on the first line with room; the notes follow each line."""
    lines: list[list[tuple[int, str, str]]] = []
    free: list[int] = []
    for read in sorted(reads, key=lambda r: (r[0], r[2])):
        line = next((i for i, end in enumerate(free) if read[0] >= end), None)
        if line is None:
            line = len(lines)
            lines.append([])
            free.append(0)
        lines[line].append(read)
        free[line] = read[0] + len(read[1]) + pad
    out = []
    for entries in lines:
        text = ""
        for at, seq, _ in entries:
            text += " " * (at - len(text)) + seq
        out.append(text + " " * max(width - len(text), 5) + "".join(f"{note}," for _, _, note in entries))
    return out


def plot_reads(reads: DataFrame, chrom: int, pos1: int, pos2: int, pad: int = 5) -> DataFrame:
    """Lines (number, line) of the reads wholly inside the view."""
    inside = reads.where((F.col("tid") == chrom) & (F.col("pos") >= pos1) & (A.position_end() <= pos2)).select("qname", "tid", "pos", "seq", "cigar")

    def draw(batch: pd.DataFrame) -> pd.DataFrame:
        entries = [(p - pos1, gapped(s, c), f"{q}>>>{t + 1}:{p}") for q, t, p, s, c in batch[["qname", "tid", "pos", "seq", "cigar"]].itertuples(index=False)]
        return pd.DataFrame(list(enumerate(packed_lines(entries, pos2 - pos1 + 1, pad))), columns=["number", "line"])

    return inside.groupBy("tid").applyInPandas(draw, "number int, line string")

"""Seed-and-extend alignment of sequences to a small set of references.

The index is a table of k-mers with their places; its size is checked before it is sent to the workers. A query's seeds at all their
places make exact matches, each of which is extended to both sides with affine gaps within the bandwidth, until z-drop, unless too few seeds
are in reach for a hit, and drawn out to the query's ends where that costs less than clipping; as every seed is looked up at all its places,
``reseed`` has nothing to add. Hits are ranked and filtered as primary and secondary.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.operators import dictionary as D

MOST_BASES = 64 << 20  # references beyond this are refused: split them, or align region by region
_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")
HITS = "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, score int, nm int, na int, xa string, comment string"


@dataclass(frozen=True)
class Scoring:
    match: int = 1
    mismatch: int = 4
    gap_open: int = 6
    gap_extend: int = 1
    clip3: int = 5
    clip5: int = 5
    bandwidth: int = 100
    zdrop: int = 100
    reseed: float = 1.5
    min_score: int = 30
    seed: int = 15

    def __post_init__(self) -> None:
        for name, value in self.__dict__.items():
            if value < 0:
                raise ValueError(f"{name} is negative")

    def scaled(self, match: int) -> Scoring:
        """Another match score, with all that depends on it in proportion."""
        f = match
        return replace(self, match=self.match * f, mismatch=self.mismatch * f, gap_open=self.gap_open * f, gap_extend=self.gap_extend * f, clip3=self.clip3 * f, clip5=self.clip5 * f, zdrop=self.zdrop * f, min_score=self.min_score * f)


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def local_alignment(query: str, target: str, s: Scoring, whole: bool = False) -> tuple[int, int, int, int, str]:
    """Best affine-gap local alignment: score, query start, target start, target end, CIGAR of the aligned part. ``whole``: both from end to end."""
    n, m = len(query), len(target)
    low = -(10**9)
    edge = lambda k: -s.gap_open - s.gap_extend * k if whole and k else 0
    h, e = [edge(j) for j in range(m + 1)], [low] * (m + 1)
    back: list[bytearray] = []
    best, at = 0, (0, 0)
    for i in range(1, n + 1):
        row, diagonal, f = bytearray(m + 1), h[0], low
        h[0], q = edge(i), query[i - 1]
        for j in range(1, m + 1):
            up = max(h[j] - s.gap_open - s.gap_extend, e[j] - s.gap_extend)
            from_e = e[j] - s.gap_extend > h[j] - s.gap_open - s.gap_extend
            e[j] = up
            left = max(h[j - 1] - s.gap_open - s.gap_extend, f - s.gap_extend)
            from_f = f - s.gap_extend > h[j - 1] - s.gap_open - s.gap_extend
            f = left
            good = diagonal + (s.match if q == target[j - 1] and q != "N" else -s.mismatch)
            diagonal = h[j]
            value = max(good, up, left) if whole else max(0, good, up, left)
            row[j] = (0 if value == 0 and not whole else 1 if value == good else 2 if value == up else 3) | (4 if from_e else 0) | (8 if from_f else 0)
            h[j] = value
            if value > best:
                best, at = value, (i, j)
        back.append(row)
    if whole:
        best, at = h[m], (n, m)
    i, j = at
    ops: list[str] = []
    state = 1
    while i > 0 and j > 0:
        move = back[i - 1][j]
        if state == 1:
            kind = move & 3
            if kind == 0:
                break
            if kind == 1:
                ops.append("M")
                i, j = i - 1, j - 1
                continue
            state = kind
        if state == 2:
            ops.append("I")
            state = 2 if move & 4 else 1
            i -= 1
        else:
            ops.append("D")
            state = 3 if move & 8 else 1
            j -= 1
    if whole:
        ops += ["I"] * i + ["D"] * j
        i = j = 0
    text, run = "", 0
    ops.reverse()
    for k, op in enumerate(ops):
        run += 1
        if k + 1 == len(ops) or ops[k + 1] != op:
            text += f"{run}{op}"
            run = 0
    return best, i, j, at[1], text


def extended(query: str, target: str, s: Scoring, clip: int = 0) -> tuple[int, int, int, bool, bool]:
    """Best affine-gap alignment from the start of both: score, query bases, target bases, whether it has gaps, whether it was drawn out.

    The end is free; paths stay within the bandwidth of the first diagonal, and none is followed once a row's best lies more than z-drop
    below the best so far, gaps between the two not counted. Where the whole query scores more than the best less ``clip``, the
    alignment is drawn out to the query's end; the score stays the best one.
    """
    low, n, m = -(10**9), len(query), min(len(target), len(query) + s.bandwidth)
    first = s.gap_open + s.gap_extend
    h = [0] + [-s.gap_open - s.gap_extend * j if j <= s.bandwidth else low for j in range(1, m + 1)]
    e = [low] * (m + 1)
    best, at = 0, (0, 0)
    end, end_at = (0, 0) if n == 0 else (low, 0)
    for i in range(1, n + 1):
        left, right = max(1, i - s.bandwidth), min(m, i + s.bandwidth)
        if left > right:
            break
        diagonal = h[left - 1]
        h[left - 1] = -s.gap_open - s.gap_extend * i if left == 1 and i <= s.bandwidth else low
        f, q = low, query[i - 1]
        most, most_at = h[left - 1], left - 1
        for j in range(left, right + 1):
            up = e[j] = max(h[j] - first, e[j] - s.gap_extend)
            f = max(h[j - 1] - first, f - s.gap_extend)
            value = max(diagonal + (s.match if q == target[j - 1] and q != "N" else -s.mismatch), up, f)
            diagonal, h[j] = h[j], value
            if value > most:
                most, most_at = value, j
        if i == n:
            end, end_at = most, most_at
        if most > best:
            best, at = most, (i, most_at)
        elif best - most - s.gap_extend * abs((i - at[0]) - (most_at - at[1])) > s.zdrop > 0:
            break
    drawn = at[0] < n and end > best - clip
    (i, j), chosen = ((n, end_at), end) if drawn else (at, best)
    # the same ends without a gap, if that is as good
    plain = i == j and chosen == sum(s.match if a == b and a != "N" else -s.mismatch for a, b in zip(query[:i], target[:i]))
    return best, i, j, not plain, drawn


CELLS = 1 << 24  # of the matrices of one batch of alignments


def aligned_pairs(queries: list[str | None], targets: list[str | None], s: Scoring) -> list[tuple]:
    """(score, target start, CIGAR with clipped ends, nm) of the local alignment of each pair; of Nones where one of the two is None.

    Pairs of equal lengths are aligned together, a cell of all of them at a time, by the steps of ``local_alignment``.
    """
    out: list[tuple] = [(None, None, None, None)] * len(queries)
    alike: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, (q, t) in enumerate(zip(queries, targets)):
        if q is not None and t is not None:
            alike[len(q), len(t)].append(k)
    for (n, m), places in alike.items():
        if not n or not m:
            for k in places:
                out[k] = (0, 0, "*", 0)
            continue
        many = max(1, CELLS // (n * m))
        for at in range(0, len(places), many):
            part = places[at : at + many]
            for k, row in zip(part, _aligned_alike([queries[k] for k in part], [targets[k] for k in part], n, m, s)):
                out[k] = row
    return out


def _aligned_alike(queries: list[str], targets: list[str], n: int, m: int, s: Scoring) -> list[tuple]:
    letters = lambda texts, w: np.ascontiguousarray(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(-1, w).T)
    size, q, t = len(queries), letters(queries, n), letters(targets, m)
    first, low = s.gap_open + s.gap_extend, -(10**9)
    h, e = np.zeros((m + 1, size), np.int32), np.full((m + 1, size), low, np.int32)
    back = np.zeros((n, m + 1, size), np.uint8)
    best, best_i, best_j = (np.zeros(size, np.int32) for _ in range(3))
    for i in range(1, n + 1):
        diagonal, f = h[0].copy(), np.full(size, low, np.int32)
        known = q[i - 1] != ord("N")
        for j in range(1, m + 1):
            opened, longer = h[j] - first, e[j] - s.gap_extend
            from_e = longer > opened
            up = e[j] = np.maximum(opened, longer)
            opened, longer = h[j - 1] - first, f - s.gap_extend
            from_f = longer > opened
            f = np.maximum(opened, longer)
            good = diagonal + np.where((q[i - 1] == t[j - 1]) & known, s.match, -s.mismatch).astype(np.int32)
            diagonal = h[j].copy()
            value = np.maximum(np.maximum(good, up), np.maximum(f, 0))
            back[i - 1, j] = np.where(value == 0, 0, np.where(value == good, 1, np.where(value == up, 2, 3))) | from_e * np.uint8(4) | from_f * np.uint8(8)
            h[j] = value
            more = value > best
            best, best_i, best_j = np.where(more, value, best), np.where(more, i, best_i), np.where(more, j, best_j)
    # back from the best cells, all together; an operation is a letter, written from the end
    i, j, every = best_i.copy(), best_j.copy(), np.arange(size)
    ops, state, edits = np.zeros((size, n + m), np.uint8), np.ones(size, np.uint8), np.zeros(size, np.int32)
    at = np.full(size, n + m)
    live = every[(i > 0) & (j > 0)]
    while len(live):
        move = back[i[live] - 1, j[live], live]
        kind, now = move & 3, state[live]
        ended = (now == 1) & (kind == 0)
        turned = np.where(now == 1, kind, now)
        live, move, turned = live[~ended], move[~ended], turned[~ended]
        at[live] -= 1
        a, b, c = live[turned == 1], live[turned == 2], live[turned == 3]
        ops[live, at[live]] = np.frombuffer(b" MID", np.uint8)[turned]
        edits[a] += q[i[a] - 1, a] != t[j[a] - 1, a]
        edits[b] += 1
        edits[c] += 1
        state[live] = np.where(turned == 1, 1, np.where(turned == 2, np.where(move & 4, 2, 1), np.where(move & 8, 3, 1)))
        i[a] -= 1
        j[a] -= 1
        i[b] -= 1
        j[c] -= 1
        live = live[(i[live] > 0) & (j[live] > 0)]
    text, rows = ops.tobytes().decode("ascii"), []
    for k, (score, head, start, end, place, nm) in enumerate(zip(best.tolist(), i.tolist(), j.tolist(), best_i.tolist(), at.tolist(), edits.tolist())):
        cigar = _cigar(text[k * (n + m) + place : (k + 1) * (n + m)])
        tail = n - end
        rows.append((score, start, (f"{head}S" if head else "") + cigar + (f"{tail}S" if tail else "") if cigar else "*", nm))
    return rows


@lru_cache(maxsize=1 << 16)
def _cigar(operations: str) -> str:
    return "".join(f"{len(list(run))}{op}" for op, run in groupby(operations))


class Index:
    """k-mer places of named references."""

    def __init__(self, references: list[tuple[str, str]], scoring: Scoring):
        if any(not name or not seq for name, seq in references):
            raise ValueError("a reference needs a name and a sequence")
        if sum(len(s) for _, s in references) > MOST_BASES:
            raise ValueError("the references are too large for one index")
        self.references, self.scoring = [(n, s.upper()) for n, s in references], scoring
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.least: dict[int, int] = {}
        for r, (_, seq) in enumerate(self.references):
            for at in range(len(seq) - scoring.seed + 1):
                self.places[seq[at : at + scoring.seed]].append((r, at))

    def candidates(self, query: str) -> list[tuple[int, int, int, int]]:
        """(reference, start, query start, length) of all exact matches of a seed or more from which a hit could come."""
        seed, reach = self.scoring.seed, self.scoring.bandwidth
        seen: dict[int, dict[int, list[int]]] = {}  # reference -> diagonal -> query places of its seeds
        for at in range(len(query) - seed + 1):
            word = query[at : at + seed]
            if "N" not in word:
                for r, place in self.places.get(word, ()):
                    seen.setdefault(r, {}).setdefault(place - at, []).append(at)
        least, found = self._least_seeds(len(query)), []
        for r, by_diagonal in seen.items():
            diagonals, before = sorted(by_diagonal), [0]
            for d in diagonals:
                before.append(before[-1] + len(by_diagonal[d]))
            for d in diagonals:
                # from its seed a path goes ``reach`` diagonals at most to the left, and as many to the right
                if before[bisect_right(diagonals, d + reach)] - before[bisect_left(diagonals, d - reach)] < least:
                    continue
                places = by_diagonal[d]
                start = places[0]
                for one, other in zip(places, [*places[1:], None]):
                    if other != one + 1:
                        found.append((r, start + d, start, one + seed - start))
                        start = other
        return found

    def _threshold(self, length: int) -> int:
        return min(self.scoring.min_score, self.scoring.match * length)

    def _least_seeds(self, length: int) -> int:
        """The fewest seeds that a hit can have. With e edits its matches are e + 1 runs, each ``seed`` - 1 bases longer than it has seeds at most."""
        s = self.scoring
        if length not in self.least:
            edit = min(s.mismatch, s.gap_open + s.gap_extend)
            most = lambda seeds: max(s.match * min(length, seeds + (s.seed - 1) * (e + 1)) - edit * e for e in range(length + 1))
            self.least[length] = next((n for n in range(1, length + 1) if most(n) >= self._threshold(length)), 1)
        return self.least[length]

    def align(self, query: str, hardclip: bool = False) -> list[tuple]:
        """Hits (score, reference, position, reverse, cigar, nm, stored sequence), best first, one per place."""
        found: dict[tuple, tuple] = {}
        s = self.scoring
        for reverse, seq in ((False, query.upper()), (True, reverse_complement(query.upper()))):
            before_clip, after_clip = (s.clip3, s.clip5) if reverse else (s.clip5, s.clip3)
            for r, t0, q0, size in self.candidates(seq):
                target = self.references[r][1]
                before, qn, tn, gaps, drawn = extended(seq[:q0][::-1], target[max(0, t0 - q0 - s.bandwidth) : t0][::-1], s, before_clip)
                after, qm, tm, more, longer = extended(seq[q0 + size :], target[t0 + size : t0 + len(seq) - q0 + s.bandwidth], s, after_clip)
                score, q0, t0, q1, t1 = before + s.match * size + after, q0 - qn, t0 - tn, q0 + size + qm, t0 + size + tm
                if score < self._threshold(len(seq)) or (r, t0, reverse) in found and found[r, t0, reverse][0] >= score:
                    continue
                cigar = f"{q1 - q0}M"
                if (gaps or more) and (drawn or longer):
                    cigar = local_alignment(seq[q0:q1], target[t0:t1], s, whole=True)[4]
                elif gaps or more:
                    again, qa, ta, _, cigar = local_alignment(seq[q0:q1], target[t0:t1], s)
                    score, q0, t0 = again, q0 + qa, t0 + ta
                used = sum(int(n) for n, o in _operations(cigar) if o in "MI")
                tail, clip = len(seq) - q0 - used, "H" if hardclip else "S"
                full = (f"{q0}{clip}" if q0 else "") + cigar + (f"{tail}{clip}" if tail else "")
                key = (r, t0, reverse)
                hit = (score, r, t0, reverse, full, _edits(seq, q0, target, t0, cigar), seq[q0 : q0 + used] if hardclip else seq)
                if key not in found or found[key][0] < score:
                    found[key] = hit
        return sorted(found.values(), key=lambda h: (-h[0], h[1], h[2], h[3]))


def _operations(cigar: str) -> list[tuple[str, str]]:
    import re

    return re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)


def _edits(seq: str, q: int, target: str, t: int, cigar: str) -> int:
    edits = 0
    for n, op in ((int(n), o) for n, o in _operations(cigar)):
        if op == "M":
            edits += sum(a != b for a, b in zip(seq[q : q + n], target[t : t + n]))
            q, t = q + n, t + n
        else:
            edits += n
            q, t = (q + n, t) if op == "I" else (q, t + n)
    return edits


def align_sequences(sequences: DataFrame, references: DataFrame, scoring: Scoring | None = None, keep_secondary: float = 0.9, max_secondary: int = 10, hardclip: bool = False, copy_comment: bool = False) -> DataFrame:
    """Hits of each sequence (name, seq, optional comment), the first primary; later ones are flagged secondary and need ``keep_secondary``
    of its score. The tag columns na (hits), nm, score and xa (other places) go with each. Unaligned sequences give no row."""
    scoring = scoring or Scoring()
    size = references.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    if size > MOST_BASES:
        raise ValueError("the references are too large for one index")
    shared = sequences.sparkSession.sparkContext.broadcast([(r["name"], r["seq"]) for r in references.select("name", "seq").collect()])
    comment = F.col("comment") if "comment" in sequences.columns and copy_comment else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(shared.value, scoring)
        names = [n for n, _ in index.references]
        for batch in batches:
            rows = []
            for name, seq, note in batch[["name", "seq", "comment"]].itertuples(index=False):
                hits = index.align(seq, hardclip)
                hits = [h for k, h in enumerate(hits) if k == 0 or (h[0] >= keep_secondary * hits[0][0] and k <= max_secondary)]
                for k, (score, r, pos, reverse, cigar, nm, stored) in enumerate(hits):
                    second = hits[1][0] if len(hits) > 1 else 0
                    mapq = 60 if k == 0 and second == 0 else max(0, min(60, int(60 * (1 - second / score)))) if k == 0 else 0
                    xa = "".join(f"{names[o[1]]},{'-' if o[3] else '+'}{o[2] + 1},{o[4]},{o[5]};" for o in hits if o is not hits[k])
                    rows.append((name, (16 if reverse else 0) | (256 if k else 0), r, pos, mapq, cigar, stored, score, nm, len(hits), xa or None, note))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HITS.split(", ")])

    return sequences.select("name", "seq", comment.alias("comment")).mapInPandas(run, HITS)


def pieces(sequences: DataFrame, at: Column, length: int, *columns: str) -> DataFrame:
    """A row (columns, at, piece) for each 0-based place of the array ``at``: the ``length`` letters there, fewer at the end.

    A substring of a text is looked for from its beginning, which makes the work on a long one quadratic. Bytes are cut where they are;
    texts with letters of several bytes are cut as texts.
    """
    plain = F.octet_length("seq") == F.length("seq")
    whole = sequences.select(*columns, F.when(~plain, F.col("seq")).alias("__text"), F.when(plain, F.col("seq").cast("binary")).alias("__raw"), at.alias("__at"))
    cut = whole.select(*columns, "__text", "__raw", F.explode("__at").alias("at"))  # apart from the select before, which must not run for each place
    start = F.col("at") + 1
    return cut.select(*columns, "at", F.coalesce(F.substring("__raw", start, F.lit(length)).cast("string"), F.substring("__text", start, F.lit(length))).alias("piece"))


def seed_index(references: DataFrame, k: int = 15) -> DataFrame:
    """The index as a table (kmer, name, at) for storage and for joins."""
    found = pieces(references.where(F.length("seq") >= k), F.sequence(F.lit(0), F.length("seq") - k), k, "name")
    return found.select(F.col("piece").alias("kmer"), "name", "at")


def index_dictionary(references: DataFrame) -> DataFrame:
    """The references in order of their names, as a dictionary."""
    rows = [(r["name"], r["n"]) for r in references.select("name", F.length("seq").alias("n")).collect()]
    return D.from_pairs(references.sparkSession, rows)


def write_index(references: DataFrame, path: str, k: int = 15) -> None:
    """The references and their seed index as tables below ``path``; an existing index is refused."""
    references.select("name", "seq").write.mode("errorifexists").parquet(f"{path}/references")
    seed_index(references, k).write.mode("errorifexists").parquet(f"{path}/seeds")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(references, seeds) of a stored index."""
    return spark.read.parquet(f"{path}/references"), spark.read.parquet(f"{path}/seeds")


def smith_waterman(query: Column, target: Column, scoring: Scoring | None = None) -> Column:
    """struct<score, pos, cigar, nm> of the local alignment of two string columns, clipped query ends as S; null strings give null."""
    scoring = scoring or Scoring()

    @F.pandas_udf("score int, pos int, cigar string, nm int")
    def aligned(queries: pd.Series, targets: pd.Series) -> pd.DataFrame:
        rows = aligned_pairs([None if q is None else q.upper() for q in queries], [None if t is None else t.upper() for t in targets], scoring)
        return pd.DataFrame(rows, columns=["score", "pos", "cigar", "nm"])

    return aligned(query, target)

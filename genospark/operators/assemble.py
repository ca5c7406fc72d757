"""Local assembly: reads of each region become unitigs of a de Bruijn graph, one group per region, so regions must be of bounded size."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.operators.align import reverse_complement

UNITIGS = "group string, id int, name string, seq string, reads int, depth double, links array<struct<target:int,source_reverse:boolean,target_reverse:boolean>>"


@dataclass(frozen=True)
class Options:
    k: int = 31
    min_count: int = 2
    max_count: int | None = None  # k-mers seen more often, repeats, are left out
    min_overlap: int | None = None  # bases that neighbours share at least: k is raised to one more
    aggressive_trim: bool = False  # weak branches that end soon go
    simplify_bubbles: bool = False  # weak branches that soon join the graph again go
    drop_ratio: float = 0.7  # a branch is weak below 1 - drop_ratio of the strongest one beside it
    min_reads: int = 1

    @property
    def length(self) -> int:
        return max(self.k, (self.min_overlap or 0) + 1)

    def with_coverage(self, kcov: float) -> Options:
        """Thresholds that follow the k-mer coverage."""
        return replace(self, min_count=max(self.min_count, int(kcov * 0.1 + 0.499)))


def _canonical(kmer: str) -> str:
    return min(kmer, reverse_complement(kmer))


def unitigs(reads: list[str], options: Options) -> list[tuple[str, int, float, list[tuple[int, bool, bool]]]]:
    """(sequence, reads, mean k-mer depth, links) of the maximal unbranched paths, longest first."""
    k = options.length
    text = "\n".join(reads).upper()
    if k <= 31 and k % 2 and not (options.simplify_bubbles or options.aggressive_trim) and not set(text) - set("ACGTN\n"):
        return _packed_unitigs(text, options)
    counts: Counter[str] = Counter()
    for read in reads:
        read = read.upper()
        counts.update(_canonical(read[i : i + k]) for i in range(len(read) - k + 1) if "N" not in read[i : i + k])
    solid = {m for m, n in counts.items() if options.min_count <= n <= (options.max_count or n)}
    if options.simplify_bubbles or options.aggressive_trim:
        solid = _without_weak_branches(solid, counts, options)

    def after(kmer: str) -> list[str]:
        return [m for m in (kmer[1:] + b for b in "ACGT") if _canonical(m) in solid]

    def extended(kmer: str, used: set[str]) -> list[str]:
        path = [kmer]
        while True:
            following = after(path[-1])
            if len(following) != 1 or len(after(reverse_complement(following[0]))) != 1 or _canonical(following[0]) in used:
                return path
            used.add(_canonical(following[0]))
            path.append(following[0])

    seen: set[str] = set()
    found: list[tuple[str, list[str]]] = []
    for start in sorted(solid):
        if start in seen:
            continue
        seen.add(start)
        forward = extended(start, seen)
        backward = extended(reverse_complement(start), seen)
        path = [reverse_complement(m) for m in reversed(backward[1:])] + forward
        found.append((path[0] + "".join(m[-1] for m in path[1:]), path))
    found.sort(key=lambda f: (-len(f[0]), f[0]))
    ends: dict[str, list[tuple[int, bool]]] = defaultdict(list)  # first k-mer in each direction -> unitig, whether reversed
    for n, (seq, path) in enumerate(found):
        ends[path[0]].append((n, False))
        ends[reverse_complement(path[-1])].append((n, True))
    unit = {_canonical(m): n for n, (_, path) in enumerate(found) for m in path}
    support = Counter(n for r in map(str.upper, reads) for n in {unit.get(_canonical(r[i : i + k])) for i in range(len(r) - k + 1)})
    out = []
    for n, (seq, path) in enumerate(found):
        links = []
        for reverse, tip in ((False, path[-1]), (True, reverse_complement(path[0]))):
            for m in after(tip):
                links += [(target, reverse, flipped) for target, flipped in ends.get(m, ())]
        inside = {_canonical(m) for m in path}
        out.append((seq, support[n], sum(counts[c] for c in inside) / len(inside), links))
    return [u for u in out if u[1] >= options.min_reads]


_LETTERS = np.full(256, 4, np.uint8)
_LETTERS[list(b"ACGT")] = range(4)


def _packed_unitigs(text: str, options: Options) -> list[tuple[str, int, float, list[tuple[int, bool, bool]]]]:
    """``unitigs`` of reads parted by line ends, for odd k up to 31 and no letters but ACGTN: k-mers are numbers, two bits a base, which sort as
    the texts do. Node 2 i is the i-th solid k-mer as its canonical text, node 2 i + 1 its reverse complement."""
    k = options.length
    letters = _LETTERS[np.frombuffer(text.encode(), np.uint8)]
    size = len(letters) - k + 1
    if size <= 0:
        return []
    bases, bad = letters.astype(np.uint64), np.concatenate([[0], np.cumsum(letters == 4)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    plain, other = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    for i in range(k):
        part = bases[i : i + size] & np.uint64(3)
        plain = plain << np.uint64(2) | part
        other |= (np.uint64(3) - part) << np.uint64(2 * i)
    kmers, places, counts = np.unique(np.minimum(plain, other)[at], return_inverse=True, return_counts=True)
    kept = (counts >= options.min_count) & (counts <= (options.max_count or len(text)))
    number = np.where(kept, np.cumsum(kept) - 1, -1)
    solid, depth, places = kmers[kept], counts[kept], number[places]
    if not len(solid):
        return []
    flipped = np.zeros(len(solid), np.uint64)
    for i in range(k):
        flipped = flipped << np.uint64(2) | (np.uint64(3) - (solid >> np.uint64(2 * i) & np.uint64(3)))
    codes = np.stack([solid, flipped], axis=1).ravel()
    mask, high = np.uint64((1 << 2 * k) - 1), np.uint64(2 * (k - 1))
    mirrored = np.stack([flipped, solid], axis=1).ravel()
    after = np.full((len(codes), 4), -1, np.int64)
    for b in range(4):
        y, z = (codes << np.uint64(2) | np.uint64(b)) & mask, mirrored >> np.uint64(2) | np.uint64(3 - b) << high
        least = np.minimum(y, z)
        found_at = np.minimum(np.searchsorted(solid, least), len(solid) - 1)
        after[:, b] = np.where(solid[found_at] == least, 2 * found_at + (y > z), -1)
    ways, only = (after >= 0).sum(axis=1), after.max(axis=1)
    following = np.where((ways == 1) & (ways[only ^ 1] == 1), only, -1).tolist()
    used = bytearray(len(solid))

    def extended(node: int) -> list[int]:
        path = [node]
        while (node := following[node]) >= 0 and not used[node >> 1]:
            used[node >> 1] = 1
            path.append(node)
        return path

    found: list[tuple[str, np.ndarray]] = []
    for start in range(len(solid)):
        if not used[start]:
            used[start] = 1
            forward, backward = extended(2 * start), extended(2 * start + 1)
            path = np.array([m ^ 1 for m in reversed(backward[1:])] + forward)
            first = int(codes[path[0]])
            head = "".join("ACGT"[first >> 2 * i & 3] for i in range(k - 1, 0, -1))
            found.append((head + np.frombuffer(b"ACGT", np.uint8)[(codes[path] & np.uint64(3)).astype(np.int64)].tobytes().decode(), path))
    found.sort(key=lambda f: (-len(f[0]), f[0]))
    ends: dict[int, list[tuple[int, bool]]] = defaultdict(list)
    unit = np.zeros(len(solid), np.int64)
    for n, (_, path) in enumerate(found):
        ends[int(path[0])].append((n, False))
        ends[int(path[-1]) ^ 1].append((n, True))
        unit[path >> 1] = n
    read = np.cumsum(np.frombuffer(text.encode(), np.uint8) == 10)[at]
    inside = places >= 0
    both = read[inside] * len(found) + unit[places[inside]]
    both = np.unique(both[np.concatenate([[True], both[1:] != both[:-1]])])
    support = np.bincount(both % len(found), minlength=len(found)).tolist()
    out = []
    for n, (seq, path) in enumerate(found):
        links = []
        for reverse, tip in ((False, int(path[-1])), (True, int(path[0]) ^ 1)):
            for m in after[tip].tolist():
                links += [(target, reverse, flip) for target, flip in ends.get(m, ())] if m >= 0 else []
        out.append((seq, support[n], int(depth[path >> 1].sum()) / len(path), links))
    return [u for u in out if u[1] >= options.min_reads]


def _without_weak_branches(solid: set[str], counts: Counter, options: Options) -> set[str]:
    """The k-mers without those of weak branches of at most 2 k k-mers, as the options ask: dead ends, and ways that join the graph again."""
    after = lambda kmer: [m for m in (kmer[1:] + b for b in "ACGT") if _canonical(m) in solid]
    drop: set[str] = set()
    for m in solid:
        for kmer in (m, reverse_complement(m)):
            branches = after(kmer)
            top = max((counts[_canonical(b)] for b in branches), default=0)
            for branch in branches:
                if counts[_canonical(branch)] >= (1 - options.drop_ratio) * top:
                    continue
                path, wanted = [branch], False
                while len(path) <= 2 * options.length:
                    following = after(path[-1])
                    if not following:
                        wanted = options.aggressive_trim
                        break
                    if len(following) > 1:
                        break
                    if len(after(reverse_complement(following[0]))) > 1:
                        wanted = options.simplify_bubbles
                        break
                    path.append(following[0])
                if wanted:
                    drop.update(map(_canonical, path))
    return solid - drop


def assemble(reads: DataFrame, options: Options | None = None, group: str = "group", seq: str = "seq") -> DataFrame:
    """Unitigs of each group of reads. Reads of one group are gathered in one task: group by region, not by chromosome."""
    options = options or Options()

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        found = unitigs([s for s in batch["seq"] if s], options)
        rows = [(str(key[0]), i, f"{key[0]}:{i}", s, n, d, [dict(zip(("target", "source_reverse", "target_reverse"), x)) for x in links]) for i, (s, n, d, links) in enumerate(found)]
        return pd.DataFrame(rows, columns=["group", "id", "name", "seq", "reads", "depth", "links"])

    return reads.select(F.col(group).cast("string").alias("group"), F.col(seq).alias("seq")).groupBy("group").applyInPandas(run, UNITIGS)


def graph_tables(assembled: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Segments and links of all groups, as the GFA writer takes them; ids count within a group, names (group:id) are of one graph."""
    segments = assembled.select("id", "name", "seq", "reads", "depth")
    links = assembled.select("group", F.col("id").alias("source"), F.explode("links").alias("l")).select("group", "source", "l.target", "l.source_reverse", "l.target_reverse", F.lit(overlap).alias("overlap"))
    named = [F.concat_ws(":", "group", F.col(c).cast("string")).alias(f"{c}_name") for c in ("source", "target")]
    return segments, links.select("*", *named)

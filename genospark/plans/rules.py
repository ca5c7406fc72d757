"""The JSON rule language: parsed to dataclasses, compiled to one boolean Column.

A collection holds filters; a filter has regions (or the whole genome) and rules; a rule is a conjunction. A filter passes if one of its
rules does, or if it has none. A read is kept if a filter that overlaps it passes and no excluding filter does.
"""

from __future__ import annotations

import functools
import json
import operator
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.functions import cigar as C
from genospark.functions import flags as A
from genospark.functions import sequence as S
from genospark.functions.hashing import keep_fraction
from genospark.functions.motif import contains_motif

SEED = 999


@dataclass(frozen=True)
class Range:
    """Passes low <= v <= high, or outside of it if inverted; open above where high is None."""

    low: int
    high: int | None
    inverted: bool = False

    @staticmethod
    def parse(value: object) -> Range:
        if isinstance(value, bool):
            return Range(1, None, not value)
        if isinstance(value, int):
            return Range(value, None)
        if isinstance(value, list) and len(value) == 2 and all(isinstance(v, int) and not isinstance(v, bool) for v in value):
            a, b = value
            return Range(b, a, True) if a > b else Range(a, b)
        raise ValueError(f"not a range: {value!r}")

    def column(self, v: Column) -> Column:
        inside = v >= self.low if self.high is None else v.between(self.low, self.high)
        return ~inside if self.inverted else inside

    def describe(self, name: str) -> str:
        span = f"[{self.low},{'inf' if self.high is None else self.high}]"
        return f"{name}: {'NOT ' if self.inverted else ''}{span}"


RANGES: dict[str, Callable[[], Column]] = {
    "isize": A.full_insert_size, "mapq": lambda: F.col("mapq"), "ins": lambda: C.longest("I"), "del": lambda: C.longest("D"),
    "nm": lambda: F.coalesce(F.col("nm"), F.lit(0)), "nbases": S.n_bases, "length": lambda: F.col("l_qseq"), "clip": C.clip,
    "xp": lambda: S.list_count(S.z_tag("XA")), "phred": lambda: S.mean_phred(),
}
FLAGS: dict[str, Callable[[], Column]] = {
    "duplicate": A.duplicate, "supplementary": A.secondary, "qcfail": A.qc_fail, "mapped": A.mapped, "mate_mapped": A.mate_mapped, "paired": A.paired,
    "fwd_strand": lambda: ~A.reverse(), "rev_strand": A.reverse, "mate_fwd": lambda: ~A.mate_reverse(), "mate_rev": A.mate_reverse,
}
ORIENTATIONS = {"ff": A.FF, "fr": A.FR, "rf": A.RF, "rr": A.RR}
MASKS = ("allflag", "!allflag", "anyflag", "!anyflag")


@dataclass(frozen=True)
class Rule:
    ranges: dict[str, Range] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)  # named flags, hardclip, orientations and ic
    masks: dict[str, int] = field(default_factory=dict)
    read_group: str | None = None
    subsample: float | None = None
    motifs: tuple[str, ...] | None = None
    motifs_inverted: bool = False

    @staticmethod
    def parse(spec: dict, base: Rule | None = None, read_motifs: Callable[[str], list[str]] | None = None) -> Rule:
        """``spec`` on top of the global rule ``base``. Unknown keys are passed over."""
        base = base or Rule()
        ranges, flags, masks = dict(base.ranges), dict(base.flags), dict(base.masks)
        more: dict = {}
        for key, value in spec.items():
            if key in RANGES:
                ranges[key] = Range.parse(value)
            elif key in FLAGS or key in ORIENTATIONS or key in ("hardclip", "ic"):
                if not isinstance(value, bool):
                    raise ValueError(f"{key} takes true or false")
                flags[key] = value
            elif key in MASKS:
                if not isinstance(value, int) or isinstance(value, bool) or value == 0:
                    raise ValueError(f"{key} takes a mask other than 0")
                masks[key] = value
            elif key == "rg":
                more["read_group"] = str(value)
            elif key == "subsample":
                more["subsample"] = float(value)
            elif key in ("motif", "!motif"):
                found = value if isinstance(value, list) else (read_motifs or motif_file)(value)
                more |= {"motifs": tuple(found), "motifs_inverted": key == "!motif"}
        return replace(base, ranges=ranges, flags=flags, masks=masks, **more)

    def column(self, strict_supplementary: bool = False) -> Column:
        """The conjunction, cheap tests first; a rule without tests is true."""
        tests: list[Column] = []
        flag = F.col("flag")
        if self.subsample is not None:
            tests.append(keep_fraction(F.col("qname"), self.subsample, SEED))
        if "isize" in self.ranges:
            tests.append(self.ranges["isize"].column(A.full_insert_size()))
        if self.read_group is not None:
            tests.append(A.read_group() == self.read_group)
        if "mapq" in self.ranges:
            tests.append(self.ranges["mapq"].column(F.col("mapq")))
        for kind, mask in self.masks.items():
            bits = flag.bitwiseAND(mask)
            tests.append({"allflag": bits == mask, "!allflag": bits != mask, "anyflag": bits != 0, "!anyflag": bits == 0}[kind])
        for name, on in self.flags.items():
            if name in FLAGS:
                test = A.supplementary() if name == "supplementary" and strict_supplementary else FLAGS[name]()
                tests.append(test if on else ~test)
        if "hardclip" in self.flags:
            has = C.hard_clip() > 0
            tests.append(F.when(C.operations() > 1, has if self.flags["hardclip"] else ~has).otherwise(True))
        tests += self._orientation()
        for name in ("ins", "del"):
            if name in self.ranges:
                tests.append(self.ranges[name].column(RANGES[name]()))
        if self.motifs is not None:
            hit = contains_motif(F.col("seq"), self.motifs)
            tests.append(~hit if self.motifs_inverted else hit)
        for name in ("nm", "nbases", "length", "clip", "xp", "phred"):
            if name in self.ranges:
                tests.append(self.ranges[name].column(RANGES[name]()))
        return functools.reduce(operator.and_, tests) if tests else F.lit(True)

    def _orientation(self) -> list[Column]:
        """Any of ff, fr, rf, rr, ic asks for a mapped pair; the first four are judged within a chromosome only."""
        asked = {k: v for k, v in self.flags.items() if k in ORIENTATIONS or k == "ic"}
        if not asked:
            return []
        tests = [A.pair_mapped()]
        inter = A.interchromosomal()
        if "ic" in asked:
            tests.append(inter if asked["ic"] else ~inter)
        for name, on in asked.items():
            if name in ORIENTATIONS:
                is_it = A.pair_orientation() == ORIENTATIONS[name]
                tests.append(inter | (is_it if on else ~is_it))
        return tests

    @property
    def is_every(self) -> bool:
        return self == Rule()

    def describe(self) -> str:
        parts = [r.describe(n) for n, r in self.ranges.items()] + [f"{n}: {'ON' if v else 'OFF'}" for n, v in self.flags.items()] + [f"{n}: {v}" for n, v in self.masks.items()]
        parts += [f"rg: {self.read_group}"] * (self.read_group is not None) + [f"subsample: {self.subsample}"] * (self.subsample is not None)
        parts += [f"{'!' * self.motifs_inverted}motif: {len(self.motifs or ())} words"] * (self.motifs is not None)
        return ", ".join(parts) or "ALL"


@dataclass(frozen=True)
class ReadFilter:
    name: str = ""
    rules: tuple[Rule, ...] = ()
    regions: tuple[tuple[int, int, int], ...] | None = None  # closed (chr, pos1, pos2); None is the whole genome
    excluder: bool = False
    mate_linked: bool = False

    def rule_column(self, strict_supplementary: bool = False) -> Column:
        tests = [r.column(strict_supplementary) for r in self.rules]
        return functools.reduce(operator.or_, tests) if tests else F.lit(True)

    def region_column(self) -> Column:
        """Overlap with few regions, as literals that reach the scan; for many see ``overlapping_reads``."""
        if self.regions is None:
            return F.lit(True)
        tests = []
        for chrom, start, end in self.regions:
            tests.append((F.col("tid") == chrom) & (F.col("pos") <= end) & (A.position_end() >= start))
            if self.mate_linked:
                tests.append((F.col("mtid") == chrom) & (F.col("mpos") <= end) & (A.mate_position_end() >= start))
        return functools.reduce(operator.or_, tests) if tests else F.lit(False)

    def column(self, strict_supplementary: bool = False) -> Column:
        if self.regions is None:
            return self.rule_column(strict_supplementary)
        return self.region_column() & self.rule_column(strict_supplementary)

    def with_regions(self, more: list[tuple[int, int, int]]) -> ReadFilter:
        """The filter with further regions, overlapping ones merged."""
        out: list[list[int]] = []
        for chrom, start, end in sorted([*(self.regions or ()), *more]):
            if out and out[-1][0] == chrom and out[-1][2] >= start:
                out[-1][2] = max(out[-1][2], end)
            else:
                out.append([chrom, start, end])
        return replace(self, regions=tuple(map(tuple, out)))


@dataclass(frozen=True)
class FilterCollection:
    filters: tuple[ReadFilter, ...] = ()

    def column(self, strict_supplementary: bool = False) -> Column:
        """Whether a read is kept. No filters keep all; an excluder that passes rejects."""
        if not self.filters:
            return F.lit(True)
        keep = [f.column(strict_supplementary) for f in self.filters if not f.excluder]
        drop = [f.column(strict_supplementary) for f in self.filters if f.excluder]
        kept = functools.reduce(operator.or_, keep) if keep else F.lit(False)
        return kept & ~functools.reduce(operator.or_, drop) if drop else kept

    def with_includer(self, rule: Rule | None = None) -> FilterCollection:
        """If only excluders exist, a whole-genome filter with the global rule comes first."""
        if self.filters and all(f.excluder for f in self.filters):
            return FilterCollection((ReadFilter("includer", (rule,) if rule else ()), *self.filters))
        return self

    def add(self, more: ReadFilter) -> FilterCollection:
        return FilterCollection((*self.filters, more))

    def regions(self) -> list[tuple[int, int, int]]:
        return [r for f in self.filters for r in f.regions or ()]

    @property
    def size(self) -> int:
        return len(self.filters)

    @property
    def rules(self) -> int:
        return sum(len(f.rules) for f in self.filters)

    def describe(self) -> str:
        out = []
        for f in self.filters:
            where = "WHOLE GENOME" if f.regions is None else f"{len(f.regions)} regions"
            out.append(f"{'Exclude' if f.excluder else 'Include'} {f.name}: {where}{', mate-linked' * f.mate_linked}")
            out += [f"  {r.describe()}" for r in f.rules]
        return "\n".join(out)

    def counts(self, reads: DataFrame) -> DataFrame:
        """One row (filter, rule, passed) per rule, per filter (rule -1) and in all (filter -1, rule -1), from one pass."""
        entries: list[tuple[int, int, Column]] = [(-1, -1, self.column())]
        for i, f in enumerate(self.filters):
            entries.append((i, -1, f.column()))
            entries += [(i, j, f.region_column() & r.column()) for j, r in enumerate(f.rules)]
        totals = reads.agg(*[F.count_if(c).alias(f"c{k}") for k, (_, _, c) in enumerate(entries)])
        rows = F.array(*[F.struct(F.lit(i).alias("filter"), F.lit(j).alias("rule"), F.col(f"c{k}").alias("passed")) for k, (i, j, _) in enumerate(entries)])
        return totals.select(F.inline(rows))


def motif_file(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [line.strip() for line in file if line.strip()]


def parse(script: str | dict, region_of: Callable[[str], list[tuple[int, int, int]]] | None = None) -> FilterCollection:
    """A rule script: JSON text, a file that holds it, or the parsed object. ``region_of`` resolves region strings and files."""
    if isinstance(script, str):
        if os.path.isfile(script):
            with open(script, encoding="utf-8") as file:
                script = file.read()
        script = json.loads(script)
    if not isinstance(script, dict):
        raise ValueError("a rule script is a JSON object")
    template = Rule.parse(script.get("global", {}))
    filters = []
    for name, spec in script.items():
        if name == "global":
            continue
        where = spec.get("region", "")
        regions = None
        if where not in ("", "WG"):
            if region_of is None:
                raise ValueError("regions need a dictionary")
            pad = int(spec.get("pad", 0))
            regions = [(c, a - pad, b + pad) for c, a, b in region_of(where)]
        rules = tuple(Rule.parse(r, template) for r in spec.get("rules", [])) or ((template,) if "global" in script else ())
        made = ReadFilter(name, rules, None, bool(spec.get("exclude", False)), bool(spec.get("matelink", False)))
        filters.append(made.with_regions(regions) if regions is not None else made)
    return FilterCollection(tuple(filters)).with_includer(template if "global" in script else None)


def apply(reads: DataFrame, collection: FilterCollection) -> DataFrame:
    return reads.where(collection.column())

"""Read-group statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genospark.functions import cigar as C
from genospark.functions import flags as A
from genospark.functions import sequence as S
from genospark.operators.intervals import swept

INTERCHROMOSOMAL = 250_000_000


def group_key() -> Column:
    """The RG tag, else the group told by the name, marked so."""
    return F.coalesce(F.col("rg"), F.concat(F.lit("QNAMED_"), A.read_group()))


def read_group_stats(reads: DataFrame, strict_supplementary: bool = False) -> DataFrame:
    """Counts per read group in one aggregation. 'supplementary' counts the secondary bit unless ``strict_supplementary``."""
    count = lambda c, n: F.count_if(c).cast("long").alias(n)
    return reads.groupBy(group_key().alias("read_group")).agg(
        F.count("*").alias("reads"), count(A.supplementary() if strict_supplementary else A.secondary(), "supplementary"), count(A.secondary(), "secondary"),
        count(A.qc_fail(), "qc_fail"), count(A.duplicate(), "duplicate"), count(~A.mapped(), "unmapped"), count(~A.mate_mapped(), "mate_unmapped"),
    )


def insert_size_value() -> Column:
    """-2 for reads whose pair isn't mapped, -1 across chromosomes, else the distance of the starts."""
    return F.when(~A.pair_mapped(), -2).when(F.col("tid") != F.col("mtid"), -1).otherwise(F.abs(F.col("pos") - F.col("mpos")))


#: Fixed value layout of the read-group histograms: lowest value, highest value, bin width.
HISTOGRAMS = {
    "mapq": (0, 100, 1, lambda: F.col("mapq")), "nm": (0, 100, 1, lambda: F.coalesce(F.col("nm"), F.lit(0))), "isize": (-2, 2000, 10, insert_size_value),
    "clip": (0, 100, 5, C.clip), "phred": (0, 100, 1, lambda: F.floor(S.mean_phred()).cast("int")), "length": (0, 250, 1, lambda: F.col("l_qseq")),
}


def bin_bounds(value: Column, low: int, high: int, width: int) -> Column:
    """struct<lo, hi> of the closed bin of a value; values outside go to the first or last bin, which may be shorter."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), value))
    lo = (F.lit(low) + F.floor((inside - low) / width) * width).cast("int")
    return F.struct(lo.alias("lo"), F.least(lo + (width - 1), F.lit(high)).cast("int").alias("hi"))


def histogram(df: DataFrame, value: Column, low: int, high: int, width: int, *keys: Column | str) -> DataFrame:
    """Non-empty bins (keys, lo, hi, n)."""
    cut = df.where(value.isNotNull()).select(*keys, bin_bounds(value, low, high, width).alias("bin"))
    names = cut.columns[:-1]
    return cut.groupBy(*names, "bin").agg(F.count("*").alias("n")).select(*names, "bin.lo", "bin.hi", "n")


def read_group_histogram(reads: DataFrame, kind: str) -> DataFrame:
    low, high, width, value = HISTOGRAMS[kind]
    return histogram(reads, value(), low, high, width, group_key().alias("read_group"))


def subtracted(one: DataFrame, other: DataFrame) -> DataFrame:
    """The counts of ``one`` less those of ``other``, bin by bin, without empty bins."""
    both = one.select("lo", "hi", "n").unionByName(other.select("lo", "hi", (-F.col("n")).alias("n")))
    return both.groupBy("lo", "hi").agg(F.sum("n").alias("n")).where("n <> 0")


def histogram_totals(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("bins"))


def histogram_csv(bins: DataFrame) -> DataFrame:
    return bins.select("lo", F.concat_ws(",", F.col("lo").cast("string"), F.col("hi").cast("string"), F.col("n").cast("string")).alias("line"))


def histogram_compact(bins: DataFrame, *keys: str) -> DataFrame:
    """lo_hi_n of the non-empty bins, comma-separated, in order. A histogram's bins are bounded, so one row holds them."""
    entry = F.struct("lo", F.concat_ws("_", F.col("lo").cast("string"), F.col("hi").cast("string"), F.col("n").cast("string")).alias("t"))
    packed = bins.where("n > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return packed.select(*keys, F.array_join(F.transform("e", lambda x: x["t"]), ",").alias("histogram"))


def read_group_table(reads: DataFrame) -> DataFrame:
    """The 13 columns of the quality report: group, six counts, six compact histograms."""
    out = read_group_stats(reads).drop("secondary")
    for kind in HISTOGRAMS:
        out = out.join(histogram_compact(read_group_histogram(reads, kind), "read_group").withColumnRenamed("histogram", kind), "read_group", "left")
    return out


def equal_frequency_bins(values: DataFrame, bins: int, min_width: int, value: str = "value") -> DataFrame:
    """Bins (lo, hi, n) of about equal counts and at least ``min_width`` values wide; the value INTERCHROMOSOMAL has a bin of its own.

    A bin ends before the first value at which it holds total / bins values or more and is wide enough. Running totals of the distinct
    values come from a sweep; each of at most ``bins`` ends, then, is one look-up by the driver, and no task holds the values in order.
    """
    plain = values.where(F.col(value) != INTERCHROMOSOMAL)
    special = values.where(F.col(value) == INTERCHROMOSOMAL).agg(F.count("*").alias("n")).where("n > 0")
    summed = swept(plain.select(F.lit(0).alias("chr"), F.col(value).cast("long").alias("p"), F.lit(1).cast("long").alias("n")), "n").persist()
    ends = summed.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.max("n").alias("total")).first()
    found, low, before = [], ends["low"], 0
    goal = max(1, -(-(ends["total"] or 0) // bins))
    while low is not None:  # the total up to the value that ends a bin, and the next value, which begins one
        full = summed.where((F.col("n") - before >= goal) & (F.col("q") - low >= min_width)).agg(F.min(F.struct("n", "q")).alias("m")).first()["m"]
        found.append((low, ends["high"], ends["total"] - before) if full is None else (low, full["q"] - 1, full["n"] - before))
        low, before = (None, 0) if full is None else (full["q"], full["n"])
    summed.unpersist()
    made = values.sparkSession.createDataFrame(found, "lo long, hi long, n long")
    own = F.lit(INTERCHROMOSOMAL).cast("long")
    return made.unionByName(special.select(own.alias("lo"), own.alias("hi"), "n"))


def quantile_bins(values: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """Approximate equal-frequency bins in one distributed pass."""
    cuts = F.percentile_approx(value, [i / bins for i in range(1, bins)], 10_000)
    edges = values.where(F.col(value) != INTERCHROMOSOMAL).agg(F.min(value).alias("low"), F.max(value).alias("high"), cuts.alias("cuts"))
    return edges.select(F.posexplode(F.concat(F.array("low"), "cuts")).alias("bin", "lo"))


def alignment_order(hits: DataFrame, fraction: float = 0.0, most: int | None = None) -> DataFrame:
    """Hits of each name ranked by mapq (high first), tid, pos; secondary ones need ``fraction`` of the first score, ``most`` of them stay."""
    w = Window.partitionBy("qname").orderBy(F.desc("mapq"), "tid", "pos", "flag", "cigar", "seq")
    ranked = hits.withColumns({"rank": F.row_number().over(w) - 1, "first": F.first("mapq").over(w)})
    kept = ranked.where((F.col("rank") == 0) | (F.col("mapq") >= fraction * F.col("first")))
    return (kept if most is None else kept.where(F.col("rank") <= most)).drop("first")

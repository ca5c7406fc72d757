"""k-mer error correction of reads, as joins: no table of k-mers is ever held by one worker.

K-mers are packed, counted once, and joined with the solid ones; only those of a read that are solid go on. Where a weak k-mer follows a solid one its last base is in doubt (and its first base where
one precedes a solid one); the k-mers with another base there are joined with the solid ones, and a place with one solid choice is changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.operators import kmers as K
from genospark.scratch import stored


@dataclass(frozen=True)
class Trained:
    k: int
    kcov: float
    min_cov: int
    solid: DataFrame  # kmer


#: Up to so many solid k-mers are sent to all workers, some 64 MB; more are joined as Spark sees fit.
SENT = 1_000_000


def checked(sequences: DataFrame) -> DataFrame:
    """Sequences with bases, and with qualities of their length or none."""
    return sequences.where((F.coalesce(F.length("seq"), F.lit(0)) > 0) & (F.col("qual").isNull() | (F.col("qual") == "") | (F.length("qual") == F.length("seq"))))


def train(sequences: DataFrame, k: int = 0, min_count: int = 3) -> Trained:
    """Solid k-mers of both strands; k 0 is learnt from the size of the data."""
    k = k or K.auto_k(sequences)
    counts = stored(K.packed_counts(sequences.select(F.upper("seq").alias("seq")), k).where(F.col("n") >= min_count), "counts")
    found = K.kmer_coverage(K.kmer_spectrum(counts), min_count).first()
    return Trained(k, found["kcov"], found["min_cov"], counts.where(F.col("n") >= found["min_cov"]).select("kmer"))


def correct(sequences: DataFrame, model: Trained, rounds: int = 2, key: str = "name") -> DataFrame:
    """``sequences`` with ``seq`` in upper case and corrected; ``key`` must be unique. Reads shorter than k stay as they are."""
    k, solid = model.k, model.solid
    if solid.limit(SENT + 1).count() <= SENT:
        solid = F.broadcast(solid)
    out = sequences.withColumn("seq", F.upper("seq"))
    for _ in range(rounds):
        reads = out.where(F.length("seq") >= k).select(F.col(key).alias("i"), "seq", (F.length("seq") - k).alias("end"))
        places = K.packed_places(reads, k, "i", "end").join(solid, "kmer", "left_semi")
        # one row per read that has solid k-mers and others: its k-mers are bounded by its length
        mixed = places.groupBy("i", "end").agg(F.collect_set("at").alias("ok")).where(F.size("ok") <= F.col("end"))
        mixed = reads.select("i", "seq").join(stored(mixed, "mixed"), "i")
        # places of weak k-mers behind a solid one, whose last base is in doubt, and before one
        behind, before = "array_except(filter(transform(ok, a -> a + 1), a -> a <= end), ok)", "array_except(filter(transform(ok, a -> a - 1), a -> a >= 0), ok)"
        doubt = "a -> struct({} as place, {} as at_end, substring(seq, a + 1, {k}) as kmer)"
        doubts = f"concat(transform({behind}, {doubt.format(f'a + {k - 1}', 'true', k=k)}), transform({before}, {doubt.format('a', 'false', k=k)}))"
        tried = mixed.select("i", F.explode(F.expr(doubts)).alias("d")).select("i", "d.*", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"))
        changed = F.when(F.col("at_end"), F.concat(F.substring("kmer", 1, k - 1), F.col("base"))).otherwise(F.concat(F.col("base"), F.substring("kmer", 2, k - 1)))
        variants = tried.withColumn("new", changed).where("new <> kmer").select("i", "place", "base", "new")
        variants = K.packed_places(variants, k, "i", "place", "base", seq="new").join(solid, "kmer", "left_semi")
        fixes = variants.groupBy("i", "place").agg(F.collect_set("base").alias("b")).where(F.size("b") == 1).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("b")[0]))).alias("fix"))
        joined = out.join(stored(fixes, "fixes"), F.col(key) == F.col("i"), "left").drop("i")
        letters = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c, j: F.coalesce(F.element_at("fix", j), c))
        out = joined.withColumn("seq", F.when(F.col("fix").isNull(), F.col("seq")).otherwise(F.array_join(letters, ""))).drop("fix")
    return out


def unique_only(sequences: DataFrame, model: Trained) -> DataFrame:
    """Sequences without those that hold a k-mer that isn't solid."""
    long = sequences.where(F.length("seq") >= model.k).select("name", "seq")
    weak = K.packed_places(long, model.k, "name").join(model.solid, "kmer", "left_anti").select("name")
    return sequences.join(weak.unionByName(long.where(F.instr("seq", "N") > 0).select("name")).distinct(), "name", "left_anti")

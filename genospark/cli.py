"""Command lines: ``correct`` (k-mer correction to FASTA) and ``assemble`` (correction and unitigs to FASTA), over FASTQ files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genospark.operators import align, assemble, correct
from genospark.shipping import ship
from genospark.sources import readers, writers


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="genospark", description=__doc__)
    parser.add_argument("command", choices=["correct", "assemble"])
    parser.add_argument("input", help="FASTQ files")
    parser.add_argument("output", help="folder to write")
    parser.add_argument("-k", type=int, default=0, help="k-mer length; 0 learns it from the data")
    parser.add_argument("--reference", help="FASTA of references: aligned BAM is written instead of FASTA")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("genospark").getOrCreate()
    ship(spark)
    reads = readers.read_fastq(spark, args.input, number=True)
    # mates may share a name, which correction takes for one read
    reads = correct.checked(reads.withColumn("name", F.concat_ws("\x01", "name", F.col("id").cast("string"))).drop("id"))
    out = correct.correct(reads, correct.train(reads, args.k))
    out = out.withColumn("name", F.substring_index("name", "\x01", 1))
    if args.command == "assemble":
        out = assemble.assemble(out.withColumn("group", F.lit("all")), assemble.Options(**({"k": args.k} if args.k else {})))
        out = out.select("name", F.lit("").alias("comment"), "seq", F.lit(None).cast("string").alias("qual"))
    if args.reference:
        references = readers.read_fasta(spark, args.reference)
        hits = align.align_sequences(out, references).withColumns({"mtid": F.lit(-1), "mpos": F.lit(-1), "isize": F.lit(0), "l_qseq": F.length("seq")})
        writers.write_bam(hits, align.index_dictionary(references), args.output)
    else:
        writers.write_lines(writers.fasta_lines(out), args.output)


if __name__ == "__main__":
    main()

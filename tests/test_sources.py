import gzip
import random

import pytest
from pyspark.sql import functions as F

from genospark.operators import dictionary as D
from genospark.sources import readers, writers

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:2\tLN:5000000\n"
SAM = HEADER + "r1\t99\tchr1\t101\t60\t5M\t=\t151\t55\tACGTA\tIIIII\tNM:i:1\tRG:Z:A\tXF:f:1.5\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n"


@pytest.fixture()
def names(spark):
    return D.from_text(spark, HEADER)


def test_dictionary(spark, names):
    assert [tuple(r) for r in names.orderBy("id").collect()] == [(0, "chr1", 1000), (1, "2", 5000000)]
    assert D.length_of(names, "chr1") == 1000 and D.length_of(names, 7) == -1 and D.id_of(names, "x") == -1
    with pytest.raises(KeyError):
        D.name_of(names, 9)
    found = D.with_id(spark.createDataFrame([("1",), ("2",), ("9",)], "n string"), names, "n", "id", True)
    assert {r["n"]: r["id"] for r in found.collect()} == {"1": 0, "2": 1, "9": -1}
    assert D.header_text(names) == "@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:2\tLN:5000000\n"


def test_sam_round_trip(spark, names, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    reads = readers.read_sam(spark, str(tmp_path / "a.sam"))
    first, second = sorted(reads.collect(), key=lambda r: r["qname"])
    assert (first["tid"], first["pos"], first["mtid"], first["mpos"], first["nm"], first["rg"], first["l_qseq"]) == (0, 100, 0, 150, 1, "A", 5)
    assert (second["tid"], second["pos"], second["qual"]) == (-1, -1, None)
    writers.write_sam(reads, names, str(tmp_path / "out"))
    again = readers.read_sam(spark, str(tmp_path / "out"), names)
    assert sorted(map(str, again.collect())) == sorted(map(str, reads.collect()))
    with pytest.raises(ValueError):
        readers.read_merged(spark, [str(tmp_path / "a.sam")] * 2, names)


def test_bam_round_trip(spark, names, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    reads = readers.read_sam(spark, str(tmp_path / "a.sam"))
    writers.write_bam(reads.coalesce(1), names, str(tmp_path / "bam"))
    for again in (readers.read_bam(spark, str(tmp_path / "bam")), spark.read.format("genospark-bam").load(str(tmp_path / "bam"))):
        pick = lambda df: sorted(str(r) for r in df.select("qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "isize", "l_qseq", "seq", "qual", "rg", "nm").collect())
        assert pick(again) == pick(reads)
    assert readers.read_bam_dictionary(spark, str(tmp_path / "bam")).count() == 2
    with pytest.raises(Exception):
        writers.write_bam(reads, names, str(tmp_path / "bam"))
    with pytest.raises(ValueError):
        writers.write_bam(reads, names, str(tmp_path / "x.cram"))


def test_fasta_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">ref1 some note\nATCG\nAC\n>ref2\nGG>G\n")
    rows = {r["name"]: r for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows["ref1"]["seq"] == "ATCGAC" and rows["ref1"]["comment"] == "some note" and rows["ref2"]["seq"] == "GG>G"
    with gzip.open(tmp_path / "a.fq.gz", "wt") as file:
        file.write("@q1 note\nACGT\n+\n@III\n@q2\nTT\n+\nII\n")
    got = readers.read_fastq(spark, str(tmp_path / "a.fq.gz")).orderBy("name").collect()
    assert [(r["name"], r["comment"], r["seq"], r["qual"]) for r in got] == [("q1", "note", "ACGT", "@III"), ("q2", "", "TT", "II")]


def test_fastq_in_splits(spark, tmp_path):
    rng = random.Random(5)
    records = {}
    for file in ("a.fq", "b.fq", "c.fq.gz"):
        lines = []
        for i in range(1500):
            n = rng.choice([0, 1, 2, 30, 200])
            seq, qual = "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@@@+I!", k=n))
            name, comment = f"{file}:{i}", rng.choice(["", "1:N:0 x", "@ +"])
            records[name] = (comment, seq, qual)
            lines += [f"@{name} {comment}" if comment else f"@{name}", seq, rng.choice(["+", "+" + name]), qual]
        end = "\r\n" if file == "b.fq" else "\n"
        with (gzip.open if file.endswith("gz") else open)(tmp_path / file, "wt", newline="") as out:
            out.write(end.join(lines) + (end if file != "c.fq.gz" else ""))
    (tmp_path / "d.fq").write_text("@d1\nAC\n+\n@@\n@d2\nAC\n+")  # the last record is cut short
    (tmp_path / "e.fq").write_text("")
    records["d1"] = ("", "AC", "@@")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "40000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.read_fastq(spark, str(tmp_path)).collect()
            assert len(got) == len(records) and {r["name"]: (r["comment"], r["seq"], r["qual"]) for r in got} == records
            ids = {r["name"]: r["id"] for r in readers.read_fastq(spark, str(tmp_path), number=True).collect()}
            again = readers.read_fastq(spark, str(tmp_path), number=True).repartition(3, "seq")
            assert len(set(ids.values())) == len(records) and {r["name"]: r["id"] for r in again.collect()} == ids
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bed_vcf(spark, names, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t5\t10\t0.5\n1\t7 9\n#2\t1\t2\n2\t8\tx\nnone\t1\t2\n2\t9\t3\n2\t1\t4")
    assert sorted((r["chr"], r["pos1"], r["pos2"]) for r in readers.read_bed(spark, str(tmp_path / "a.bed"), names).collect()) == [(0, 5, 10), (0, 7, 9), (1, 1, 4)]
    assert readers.read_bed(spark, str(tmp_path / "a.bed"), names, True).where("frac = 0.5").count() == 1
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n2\t33\t.\nchr1\tz\n")
    assert [(r["chr"], r["pos1"], r["pos2"]) for r in readers.regions(spark, str(tmp_path / "a.vcf"), names).collect()] == [(1, 33, 33)]
    one = readers.regions(spark, "2:1,000,000-2,000,000", names).first()
    assert (one["chr"], one["pos1"], one["pos2"]) == (1, 1000000, 2000000)
    assert readers.parse_region("2:7", [(1, "2", 50)]) == (1, 7, 50) and readers.parse_region("2", [(1, "2", 50)]) == (1, 1, 50)
    for bad in ("9:1-2", "2:9-3"):
        with pytest.raises(ValueError):
            readers.parse_region(bad, [(1, "2", 50)])
    lines = writers.bed_lines(readers.region_table(spark, [(1, 3, 4, "+")]), names)
    assert lines.first()["line"] == "2\t3\t4\t+"


def test_reference_query(spark):
    genome = spark.createDataFrame([("ref1", "ATCGACTTTT")], "name string, seq string")
    chunks = readers.reference_chunks(genome, 4)
    asked = spark.createDataFrame([(1, "ref1", 0, 5), (2, "none", 0, 1)], "id int, name string, pos1 int, pos2 int")
    assert {r["id"]: r["bases"] for r in readers.reference_query(chunks, asked, 4).collect()} == {1: "ATCGAC", 2: None}
    with pytest.raises(Exception, match="interval"):
        readers.reference_query(chunks, asked.withColumn("pos1", F.lit(9)), 4).collect()


def test_indexed_layout_and_motifs(spark, names, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    writers.write_indexed(readers.read_sam(spark, str(tmp_path / "a.sam")), str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).where("tid = 0 and pos < 200").count() == 1
    (tmp_path / "m").write_text("AC\n\nGT\n")
    assert readers.read_motifs(spark, str(tmp_path / "m")) == ["AC", "GT"]

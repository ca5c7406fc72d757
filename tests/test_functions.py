"""Golden values of record, CIGAR, region and string functions."""

import pytest
from pyspark.sql import functions as F

from genospark.functions import cigar as C
from genospark.functions import flags as A
from genospark.functions import motif as M
from genospark.functions import region as R
from genospark.functions import sequence as S
from genospark.operators.stats import bin_bounds


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("__"))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,query,reference", [("5M2I3D4S", 11, 8), ("10M1I10M1D10M10S", 41, 31), ("*", 0, 0), ("", 0, 0)])
def test_consumed(spark, text, query, reference):
    assert value(spark, C.query_consumed(), cigar=text) == query
    assert value(spark, C.reference_consumed(), cigar=text) == reference


def test_cigar_shapes(spark):
    assert value(spark, C.printed(C.parsed()), cigar="5M2I3D4S") == "5M2I3D4S"
    assert value(spark, C.reversed_string(), cigar="4H2S5M") == "5M2S4H"
    assert value(spark, C.alignment_start(), cigar="4H2S5M") == 2
    assert value(spark, C.alignment_end(), cigar="5M2S4H", l_qseq=7) == 1
    assert value(spark, C.overlapping_coverage(F.lit("10M"), F.lit("5S3M2I5M"))) == 3
    assert value(spark, C.valid(), cigar="5Q") is False
    assert value(spark, C.query_consumed(), cigar=None) is None


def test_reverse_complement(spark):
    assert value(spark, S.reverse_complement("s"), s="actgACGTnTCN") == "NGAnACGTcagt"
    assert value(spark, S.reverse_complement("s"), s="A-C") == "G T"


def test_strings(spark):
    assert value(spark, S.commas("n"), n=1000000) == "1,000,000"
    assert value(spark, A.percent_kept(F.lit(7), F.lit(8))) == 87
    assert value(spark, A.percent_kept(F.lit(2), F.lit(3))) == 66
    assert value(spark, A.percent_kept(F.lit(2), F.lit(0))) == 0
    assert value(spark, S.scrub("s", "chr"), s="chr1") == "1"
    assert value(spark, S.scrub("s", "ab"), s="aabb") == ""
    assert value(spark, S.n_bases("s"), s="ANNC") == 2


def test_quality_trim(spark):
    trim = lambda q: tuple(value(spark, S.quality_trim(5), qual=q, l_qseq=4))
    assert trim("!I!I") == (1, 4)
    assert trim("!!!!") == (4, -1)
    assert trim("IIII") == (0, 4)
    assert tuple(value(spark, S.quality_trim(5, F.lit(None).cast("string")), l_qseq=4)) == (0, -1)


def test_read_group(spark):
    get = lambda **c: value(spark, A.read_group(), **c)
    assert get(rg="A", qname="x:1") == "A"
    assert get(rg=None, qname="B:1") == "B"
    assert get(rg=None, qname="plain") == "NA"


@pytest.mark.parametrize("a,b,wanted", [((0, 0, 10), (0, 10, 20), 1), ((1, 0, 10), (1, 4, 10), 2), ((1, 4, 10), (1, 0, 10), 3), ((1, 4, 10), (1, 11, 12), 0), ((1, 0, 9), (1, 0, 9), 3), ((1, 0, 9), (2, 0, 9), 0)])
def test_overlap_class(spark, a, b, wanted):
    columns = dict(zip(("chr", "pos1", "pos2", "chr_b", "pos1_b", "pos2_b"), (*a, *b)))
    assert value(spark, R.overlap_class(), **columns) == wanted


def test_distance(spark):
    for b, starts, ends in (((1, 10, 100), -1, -1), ((0, 10, 200), 0, 100), ((0, 100, 100), 90, 0)):
        columns = dict(zip(("chr", "pos1", "pos2", "chr_b", "pos1_b", "pos2_b"), (0, 10, 100, *b)))
        assert value(spark, R.distance_starts(), **columns) == starts
        assert value(spark, R.distance_ends(), **columns) == ends


def test_pad(spark):
    def pad(by, chr, pos1, pos2):
        return tuple(value(spark, c, chr=chr, pos1=pos1, pos2=pos2) for c in R.padded(by))

    assert pad(3, 0, 1, 10) == (-2, 13)
    assert pad(-3, 0, 1, 11) == (4, 8)
    with pytest.raises(Exception, match="shrinks"):
        pad(-10, 0, -2, 13)


def test_format(spark):
    columns = {"chr": 0, "pos1": 10000, "pos2": 10001, "strand": "+"}
    assert value(spark, R.point_string(R.default_name()), **columns) == "1:10,000(+)"
    assert value(spark, R.to_string(R.default_name()), **columns) == "1:10,000-10,001(+)"
    assert value(spark, R.chromosome_id(F.lit("chrX"))) == 22
    with pytest.raises(Exception, match="not a region"):
        value(spark, R.checked(), chr=0, pos1=5, pos2=4, strand="+")


def test_tags(spark):
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    tags = S.with_tag("XF", "f", F.lit(1.5), tags=S.with_tag("NM", "i", F.lit(3), tags=S.with_tag("XS", "Z", F.lit("4^5"), tags=empty)))
    assert value(spark, S.tag("XF", tags)) == "1.500000"
    assert value(spark, S.int_tag("NM", tags)) == 3
    assert value(spark, S.multi_tag("XS", "int", tags)) == [4, 5]
    assert value(spark, S.tag("ZZ", tags)) is None
    assert set(value(spark, S.without_tag("NM", tags=tags))) == {"XF", "XS"}
    assert set(value(spark, S.with_tag("AA", "Z", F.lit(""), tags=tags))) == {"XF", "XS", "NM"}


def test_bins(spark):
    for v, wanted in ((-5, (-2, 7)), (0, (-2, 7)), (8, (8, 17)), (1999, (1998, 2000)), (9999, (1998, 2000))):
        assert tuple(value(spark, bin_bounds(F.lit(v), -2, 2000, 10))) == wanted


def test_motifs():
    assert M.find("xACGACGx", ["ACG", "GAC"]) == [(1, 4, "ACG"), (3, 6, "GAC"), (4, 7, "ACG")]
    assert M.find("acg", ["ACG"], ignore_case=True)[0][:2] == (0, 3)
    assert M.find("cat catalog", ["cat"], whole_words=True) == [(0, 3, "cat")]
    assert M.find("abcd", ["abc", "bcd", "d"], without_overlaps=True) == [(0, 3, "abc"), (3, 4, "d")]
    assert M.tokens("xaby", ["ab"]) == [("x", False), ("ab", True), ("y", False)]


def test_built(spark):
    def build(seq, pos1, pos2, cigar="10M1I10M1D10M10S"):
        return value(spark, A.built(*map(F.lit, ("n", seq, cigar, 0, pos1, pos2, "-"))))

    made = build("A" * 40 + "x", 100, 130)
    assert (made["pos"], made["mapq"], made["flag"], made["seq"][-1]) == (100, 60, 16, "N")
    for bad in (("A" * 42, 100, 130), ("A" * 41, 100, 131), ("A" * 41, 100, 130, "41Q")):
        with pytest.raises(Exception, match="CIGAR"):
            build(*bad)
    assert value(spark, A.with_qualities(F.lit("")), seq="AC") is None
    with pytest.raises(Exception, match="fit"):
        value(spark, A.with_qualities(F.lit("I")), seq="AC")


def test_motif_documents_need_whole_passages(spark, tmp_path):
    from genospark.plans.catalog import QUERIES

    passage = "the first letters of a passage are shared and the rest of it is not"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, f"so {passage}."), (2, passage[:40])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["doc_id"] for r in QUERIES["motif_documents_whole"](spark, str(tmp_path)).collect()] == [1]

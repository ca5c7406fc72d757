import pytest

from genospark.plans import rules
from genospark.plans.rules import Range
from genospark.schema import READ


def reads(spark, *rows):
    base = {"qname": "RG1:1", "flag": 3, "tid": 0, "pos": 100, "mapq": 30, "cigar": "10M", "mtid": 0, "mpos": 150, "isize": 0, "l_qseq": 10, "seq": "ACGTACGTAC", "qual": "IIIIIIIIII", "rg": None, "nm": 0, "tags": None}
    return spark.createDataFrame([tuple((base | r)[n] for n in READ.names) for r in rows], READ)


def kept(spark, script, *rows, where=None):
    return sorted(r["qname"] for r in rules.apply(reads(spark, *rows), rules.parse(script, where)).collect())


def test_range():
    assert Range.parse([1, 5]) == Range(1, 5) and Range.parse([5, 1]) == Range(1, 5, True)
    assert Range.parse(4) == Range(4, None) and Range.parse(True) == Range(1, None) and Range.parse(False) == Range(1, None, True)
    for bad in ([5], [1, 2, 3], "x", None, 1.5):
        with pytest.raises(ValueError):
            Range.parse(bad)


def test_bad_scripts():
    for script in ("{", "[]", '{"":{"rules":[{"anyflag":0}]}}', '{"":{"rules":[{"mapq":"x"}]}}', '{"":{"rules":[{"mapped":3}]}}', '{"":{"region":"1:1-2"}}'):
        with pytest.raises(ValueError):
            rules.parse(script)


def test_or_of_rules(spark):
    rows = [{"qname": "a", "mapq": 60}, {"qname": "b", "cigar": "5S5M"}, {"qname": "c"}, {"qname": "d", "mapq": 60, "flag": 1024 + 3}]
    assert kept(spark, {"global": {"!anyflag": 1536}, "": {"rules": [{"mapq": 50}, {"clip": 5}]}}, *rows) == ["a", "b"]


def test_missing_nm_is_zero(spark):
    assert kept(spark, {"": {"rules": [{"nm": False}]}}, {"qname": "a", "nm": None}, {"qname": "b", "nm": 2}) == ["a"]


def test_excluder_alone_gets_an_includer(spark):
    collection = rules.parse({"X": {"exclude": True, "rules": [{"mapq": 50}]}})
    assert collection.size == 2
    assert kept(spark, {"X": {"exclude": True, "rules": [{"mapq": 50}]}}, {"qname": "a", "mapq": 60}, {"qname": "b"}) == ["b"]


def test_no_filters_keep_all(spark):
    assert kept(spark, {}, {"qname": "a"}) == ["a"]


def test_regions_and_mates(spark):
    where = lambda text: [(0, 95, 99)]
    rows = [{"qname": "hit", "pos": 95}, {"qname": "mate", "pos": 500, "mpos": 90}, {"qname": "touch", "pos": 85}, {"qname": "far", "pos": 300, "mpos": 300}]
    assert kept(spark, {"A": {"region": "r"}}, *rows, where=where) == ["hit", "touch"]
    assert kept(spark, {"A": {"region": "r", "matelink": True}}, *rows, where=where) == ["hit", "mate", "touch"]


def test_orientation(spark):
    rows = [{"qname": "fr", "flag": 1 + 32}, {"qname": "ff", "flag": 1}, {"qname": "ic", "flag": 1, "mtid": 2}, {"qname": "unpaired", "flag": 0}]
    assert kept(spark, {"": {"rules": [{"fr": True}]}}, *rows) == ["fr", "ic"]
    assert kept(spark, {"": {"rules": [{"ic": True}]}}, *rows) == ["ic"]
    assert kept(spark, {"": {"rules": [{"ic": False}]}}, *rows) == ["ff", "fr"]


def test_supplementary_and_motif(spark):
    rows = [{"qname": "sec", "flag": 256}, {"qname": "supp", "flag": 2048, "seq": "GGGGGGGGGG"}]
    assert kept(spark, {"": {"rules": [{"supplementary": True}]}}, *rows) == ["sec"]
    frame = reads(spark, *rows)
    strict = rules.parse({"": {"rules": [{"supplementary": True}]}}).column(strict_supplementary=True)
    assert [r["qname"] for r in frame.where(strict).collect()] == ["supp"]
    assert kept(spark, {"": {"rules": [{"!motif": ["GGG"]}]}}, *rows) == ["sec"]


def test_files_and_counts(spark, tmp_path):
    (tmp_path / "motifs").write_text("ACGT\n\nTTTT\n")
    (tmp_path / "rules.json").write_text('{"": {"rules": [{"motif": "%s"}]}}' % (tmp_path / "motifs"))
    collection = rules.parse(str(tmp_path / "rules.json"))
    assert collection.filters[0].rules[0].motifs == ("ACGT", "TTTT") and "motif" in collection.describe()
    counts = {(r["filter"], r["rule"]): r["passed"] for r in collection.counts(reads(spark, {}, {"seq": "CCCCCCCCCC"})).collect()}
    assert counts == {(-1, -1): 1, (0, -1): 1, (0, 0): 1}


def test_added_regions_merge():
    f = rules.ReadFilter("a", regions=((0, 1, 5),)).with_regions([(0, 5, 9), (1, 1, 2)])
    assert f.regions == ((0, 1, 9), (1, 1, 2))
    assert rules.FilterCollection((f,)).regions() == [(0, 1, 9), (1, 1, 2)]

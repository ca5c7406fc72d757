import random

import pytest
from pyspark.sql import functions as F

from genospark.operators import align, assemble, correct, kmers, plot, stats
from genospark.streaming import reads as streams


def bases(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_alignment(spark):
    refs = [(f"ref{i}", bases(400, i)) for i in range(4)]
    query = align.reverse_complement(refs[2][1][100:138])
    table = spark.createDataFrame(refs, "name string, seq string")
    got = align.align_sequences(spark.createDataFrame([("q", query)], "name string, seq string"), table).collect()
    assert (got[0]["tid"], got[0]["pos"], got[0]["flag"], got[0]["cigar"], got[0]["nm"], got[0]["na"]) == (2, 100, 16, "38M", 0, 1)
    deleted = refs[1][1][50:90] + refs[1][1][93:130]
    hit = align.Index(refs, align.Scoring()).align(deleted)[0]
    assert hit[1] == 1 and hit[4] == "40M3D37M" and hit[5] == 3
    with pytest.raises(ValueError):
        align.Scoring(gap_open=-1)
    with pytest.raises(ValueError):
        align.Index([("", "A")], align.Scoring())
    assert align.Scoring().scaled(2).mismatch == 8


def test_alignment_of_repeats_and_long_gaps():
    unit = bases(60, 1)
    own = unit[:30] + ("A" if unit[30] != "A" else "C") + unit[31:]
    hits = align.Index([("r", "".join(bases(200, 100 + i) + (own if i == 99 else unit) for i in range(100)))], align.Scoring()).align(own)
    assert len(hits) == 100 and hits[0][:6] == (60, 0, 99 * 260 + 200, False, "60M", 0)
    assert {(h[0], h[5]) for h in hits[1:]} == {(55, 1)}
    genome = bases(600, 2)
    hit = align.Index([("r", genome)], align.Scoring()).align(genome[100:160] + genome[200:280])[0]
    assert (hit[0], hit[2], hit[5]) == (140 - 46, 100, 40) and hit[4].count("D") == 1
    rng = random.Random(4)
    for _ in range(20):
        at = rng.randrange(500)
        query = list(genome[at : at + 90])
        for _ in range(rng.randrange(5)):
            query[rng.randrange(len(query))] = rng.choice(["", "A", "CC", "N"])
        query = "".join(query)
        whole = align.local_alignment(query, genome, align.Scoring())[0]
        assert [h[0] for h in align.Index([("r", genome)], align.Scoring()).align(query)[:1]] == [whole] * (whole >= 30)


def test_clip_penalties_and_zdrop():
    genome = bases(600, 5)
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    query = genome[100:197] + other[genome[197]] + genome[198:200]  # a mismatch before the last two bases: 2 - 4 against a clip of 3
    one = lambda s, q=query: align.Index([("r", genome)], s).align(q)[0]
    assert one(align.Scoring())[:6] == (97, 0, 100, False, "100M", 1)
    assert one(align.Scoring(clip3=0))[4:6] == ("97M3S", 0) and one(align.Scoring(clip5=0))[4] == "100M"
    turned = align.reverse_complement(query)  # what was the end is now the beginning
    assert one(align.Scoring(clip3=0), turned)[3:5] == (True, "100M") and one(align.Scoring(clip5=0), turned)[3:5] == (True, "97M3S")
    assert one(align.Scoring(clip3=2))[4] == "97M3S" and one(align.Scoring(clip3=3))[4] == "100M"
    # a gap near the end is drawn out too, and the score stays the local one
    start = next(k for k in range(100, 200) if len({genome[k + 90], genome[k + 91]}) == 2 and genome[k + 89] != genome[k + 90])
    gap = genome[start : start + 90] + genome[start + 91 : start + 96]
    assert one(align.Scoring(), gap)[0] == 90 and one(align.Scoring(), gap)[4:6] == ("90M1D5M", 1) and one(align.Scoring(clip3=0), gap)[4] == "90M5S"
    # 40 wrong bases lie between two good halves; with gaps out of the question, only a wide z-drop gets across
    far = genome[100:160] + "".join(other[c] for c in genome[160:200]) + genome[200:400]
    plain = lambda **k: align.Scoring(gap_open=1000, **k)
    assert {h[4] for h in align.Index([("r", genome)], plain(clip3=0, clip5=0)).align(far)} == {"60M240S", "100S200M"}
    assert {h[4] for h in align.Index([("r", genome)], plain(clip3=0, clip5=0, zdrop=200)).align(far)} == {"300M", "100S200M"}
    assert one(plain(zdrop=200, clip5=200), far)[:5] == (200, 0, 100, False, "300M")
    with_drop, without = (align.extended(far[60:], genome[160:], plain(zdrop=z)) for z in (100, 0))
    assert with_drop[0] == 0 and without[:2] == (40, 240)
    rng = random.Random(8)
    for _ in range(20):
        a, b = bases(rng.randrange(1, 12), rng.random()), bases(rng.randrange(1, 12), rng.random())
        score, cigar = align.local_alignment(a, b, align.Scoring(), whole=True)[0::4]
        parts = align._operations(cigar)
        assert sum(int(n) for n, o in parts if o in "MI") == len(a) and sum(int(n) for n, o in parts if o in "MD") == len(b)
        q = t = cost = 0
        for n, o in ((int(n), o) for n, o in parts):
            cost += sum(1 if x == y else -4 for x, y in zip(a[q : q + n], b[t : t + n])) if o == "M" else -6 - n
            q, t = q + n * (o != "D"), t + n * (o != "I")
        assert cost == score


def test_correction_and_assembly(spark):
    genome = bases(600, 9)
    rows = [(f"r{i}", genome[i : i + 60]) for i in range(0, 540, 3)]
    wrong = list(rows[60][1])
    wrong[30] = "A" if wrong[30] != "A" else "C"
    rows[60] = (rows[60][0], "".join(wrong))
    reads = spark.createDataFrame([(n, s, None, "g") for n, s in rows], "name string, seq string, qual string, group string")
    model = correct.train(correct.checked(reads), 21, 3)
    fixed = {r["name"]: r["seq"] for r in correct.correct(reads, model, 2).collect()}
    assert fixed == {f"r{i}": genome[i : i + 60] for i in range(0, 540, 3)}
    left = {r["name"] for r in correct.unique_only(reads, model).collect()}  # the ends of the genome are thinly covered, too
    assert "r180" not in left and len(left) > 170
    longest = assemble.assemble(spark.createDataFrame(list(fixed.items()), "name string, seq string").withColumn("group", F.lit("g")), assemble.Options(k=25)).orderBy(F.length("seq").desc()).first()["seq"]
    assert longest in genome or align.reverse_complement(longest) in genome
    assert len(longest) > 400


def test_kmers(spark):
    counts = kmers.kmer_counts(spark.createDataFrame([("ACGTNACG",)], "seq string"), 3)
    assert {r["kmer"]: r["n"] for r in counts.collect()} == {"ACG": 2, "CGT": 1}


def test_plot():
    assert plot.gapped("ACGTAC", "1S2M1I1D2M") == "CG-AC"
    lines = plot.packed_lines([(0, "AAAA", "a"), (2, "CC", "b"), (9, "GG", "c")], 12, 5)
    assert lines == ["AAAA     GG     a,c,", "  CC        b,"]


def test_equal_frequency(spark):
    values = spark.createDataFrame([(v,) for v in [*range(100), stats.INTERCHROMOSOMAL]], "value long")
    bins = [tuple(r) for r in stats.equal_frequency_bins(values, 4, 5).orderBy("lo").collect()]
    assert bins[-1] == (stats.INTERCHROMOSOMAL, stats.INTERCHROMOSOMAL, 1) and sum(b[2] for b in bins) == 101
    assert all(b[2] == 25 for b in bins[:4])


def test_stream(spark, tmp_path):
    source = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'view' event_type union all select timestamp'2024-01-01 03:10:00', 'click'")
    source.write.parquet(str(tmp_path / "in"))
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), source.schema)
    running = streams.event_counts(stream).writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    running.awaitTermination(60)
    assert spark.sql("select event_type, n from counted").collect()[0]["event_type"] == "view"


def test_smith_waterman_and_stored_index(spark, tmp_path):
    target = bases(60, 3)
    row = spark.createDataFrame([("GGGG" + target[10:40], target), (None, target)], "q string, t string")
    got = row.select(align.smith_waterman(F.col("q"), F.col("t")).alias("a")).select("a.*").collect()
    assert got[0]["cigar"].endswith("30M") and got[0]["nm"] == 0 and got[1]["cigar"] is None
    references = spark.createDataFrame([("r", target)], "name string, seq string")
    align.write_index(references, str(tmp_path / "index"))
    again, seeds = align.load_index(spark, str(tmp_path / "index"))
    assert again.first()["seq"] == target and seeds.count() == 46
    with pytest.raises(Exception):
        align.write_index(references, str(tmp_path / "index"))
    assert align.index_dictionary(references).first()["length"] == 60


def test_engine_queries_take_all_reads(spark):
    import os

    from genospark.plans.catalog import QUERIES
    from genospark.plans.fixtures import Fixtures

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    t = Fixtures(spark, folder)
    names = sorted(r["name"] for r in t.sequences.select("name").collect())
    assert sorted(r["name"] for r in QUERIES["correct_reads"](spark, folder).select("name").collect()) == names
    places = t.reads.selectExpr("concat(tid, ':', shiftright(pos, 12)) g", "32 n").groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert QUERIES["seed_index"](spark, folder).count() == sum(r["n"] - 14 for r in places)
    firsts = t.reads.where("tid < 4").selectExpr("tid", "floor(pos / 1000) b", "qname").groupBy("tid", "b").agg(F.min("qname").alias("q")).collect()
    assert {r["q"] for r in firsts} <= {r["qname"] for r in QUERIES["align_reads"](spark, folder).select("qname").collect()}
    contigs, lines = QUERIES["assemble_contigs"](spark, folder).collect(), QUERIES["gfa_export"](spark, folder).collect()
    assert {r["group"] for r in contigs} == {r["g"] for r in places if r["n"] >= 64}  # the others have one fragment, so no k-mer twice
    assert {r["line"].split("\t")[1] for r in lines if r["kind"] == 1} == {r["name"] for r in contigs}


def test_whole_table_in_order(spark):
    import os

    from genospark.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    for name, columns in (("sorted_by_position", ("tid", "pos", "qname")), ("sorted_by_mate", ("mtid", "mpos", "qname"))):
        found = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()]
        assert len(found) == 6000 and found == sorted(found)


def test_assembly_options():
    """A dead end and a bubble, each weak, go by the option that names them; repeats and short overlaps by theirs."""
    main = bases(140, 3)
    other = "A" if main[70] != "A" else "C"
    reads = [main] * 12 + [main[:70] + other + main[71:]] * 2 + [main[:35] + ("G" if main[35] != "G" else "T")] * 2

    def found(**options):
        return {s for s, *_ in assemble.unitigs(reads, assemble.Options(k=21, **options))}

    whole = {main, align.reverse_complement(main)}
    assert len(found()) > len(found(aggressive_trim=True)) > 1 and len(found()) > len(found(simplify_bubbles=True)) > 1
    assert len(found(aggressive_trim=True, simplify_bubbles=True)) == 1 and found(aggressive_trim=True, simplify_bubbles=True) <= whole
    assert found(aggressive_trim=True) != found(simplify_bubbles=True)
    assert found(max_count=2) and not found(max_count=2) & whole
    assert all(len(s) >= 41 for s in found(min_overlap=40))

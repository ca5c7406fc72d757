"""What larger tables asked for: large keys, long sequences, dense regions."""

import os

import pytest
from pyspark.sql import functions as F

from genospark.plans.catalog import QUERIES
from genospark.plans.fixtures import Fixtures

NATION = "/root/testdata/sf0.001/nation.parquet"


@pytest.fixture
def large_keys(spark, tmp_path):
    rows = [(9_000_000 + k, 1_200_000 + k, 60_000 + k, k % 7) for k in range(50)] + [(-k, 1, 1, 1) for k in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    os.symlink(NATION, tmp_path / "nation.parquet")
    return f"file://{tmp_path}", [o * 1009 + p * 31 + s * 7 + n for o, p, s, n in rows]


def test_reads_of_large_keys(spark, large_keys):
    folder, keys = large_keys
    found = {r["qname"].split(":")[1]: r for r in Fixtures(spark, folder).reads.collect()}
    for h in keys:
        g = h * 2654435761 & 4294967295
        row = found[str(h)]
        assert (row["flag"], row["mapq"], row["nm"]) == (g >> 20, (g >> 11) % 61, None if h % 7 == 0 else (g >> 5) % 5)


@pytest.mark.skipif(not os.path.exists(NATION), reason="no test tables here")
def test_bam_of_large_keys(spark, large_keys):
    folder, keys = large_keys
    assert QUERIES["bam_round_trip"](spark, folder).count() == len(keys)
    assert QUERIES["bam_header_dictionary"](spark, folder).count() == 24


def test_share_subject_makes_no_pair_per_subject(spark):
    """Three tables against brute force: wide, touching, nested and apart, ids with several intervals too."""
    import random

    from genospark.operators import intervals as I

    rnd = random.Random(5)

    def table(n: int, same: int) -> list[tuple]:
        rows = []
        for k in range(n):
            start = rnd.randrange(3_000_000)
            rows.append((k // same, rnd.randrange(2), start, start + rnd.choice([0, 30, 5_000, 60_000, 900_000]), "*"))
        return rows

    schema = "id long, chr int, pos1 int, pos2 int, strand string"
    for same in (1, 2):
        one, other, subjects = table(60, same), table(50, same), table(40, 1)
        over = lambda x, y: x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]
        wanted = {(a[0], b[0]) for a in one for b in other if any(over(a, s) and over(b, s) for s in subjects)}
        found = I.share_subject(*[spark.createDataFrame(t, schema) for t in (one, other, subjects)])
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "subject_id" not in plan  # subjects are no key of a join


def test_narrow_intervals_are_listed_once(spark):
    from genospark.operators import intervals as I

    rows = spark.range(1000).selectExpr("id", "0 chr", "cast(id * 2048 as int) pos1", "cast(id * 2048 + 10 as int) pos2", "'*' strand")
    sides = [I._prefixed(rows, mark, ("chr", "pos1", "pos2")) for mark in "qs"]
    assert [side.count() for side in I._spread(*sides)] == [1000, 1000]
    assert I.intersection(rows, rows).count() == 1000


def test_pieces_of_long_texts_take_linear_time(spark):
    """Some 100,000 places of one long text, and letters of several bytes."""
    import time

    from pyspark.sql import functions as F

    from genospark.operators import align

    text = "ACGTTGCAAC" * 60_000
    rows = spark.createDataFrame([("a", text), ("é", "AÉGTACGTACGTACGTA")], "name string, seq string")
    began = time.time()
    found = align.seed_index(rows)
    assert found.agg(F.count("*"), F.sum(F.length("kmer"))).first()[0] == len(text) - 14 + 3
    assert time.time() - began < 60
    assert [r["kmer"] for r in found.where("name = 'é'").orderBy("at").collect()] == ["AÉGTACGTACGTACG", "ÉGTACGTACGTACGT", "GTACGTACGTACGTA"]


def test_alignments_of_many_pairs_at_once():
    import random
    import time

    from genospark.operators import align as A

    rnd, s = random.Random(2), A.Scoring(match=2, mismatch=3, gap_open=2)
    queries = ["".join(rnd.choice("ACGTN") for _ in range(rnd.choice([0, 7, 32]))) for _ in range(300)]
    targets = [q[3:12] + rnd.choice(["", "A", "GG"]) + q[14:] for q in queries]
    for q, t, found in zip(queries, targets, A.aligned_pairs(queries, targets, s)):
        score, q0, t0, _, cigar = A.local_alignment(q, t, s)
        tail = len(q) - q0 - sum(int(n) for n, o in A._operations(cigar) if o in "MI")
        assert found == (score, t0, (f"{q0}S" if q0 else "") + cigar + (f"{tail}S" if tail else "") if cigar else "*", A._edits(q, q0, t, t0, cigar))
    many = ["ACGTACGTACGTACGTACGTACGTACGTACGT"] * 20_000
    began = time.time()
    assert set(A.aligned_pairs(many, many, s)) == {(64, 0, "32M", 0)}
    assert time.time() - began < 10  # one at a time: about 30 s


def test_packed_unitigs_equal_texts():
    import random
    from unittest import mock

    from genospark.operators import assemble as S

    rnd = random.Random(4)
    for k in (3, 5, 11):
        genome = "".join(rnd.choice("ACGT") for _ in range(150))
        reads = [genome[p : p + 30] for p in (rnd.randrange(120) for _ in range(60))] + [S.reverse_complement(genome)[:40], "ACNGT", "ac"]
        options = S.Options(k=k, min_count=2)
        with mock.patch.object(S, "_packed_unitigs", side_effect=S._packed_unitigs) as packed:
            found = S.unitigs(reads, options)
        assert packed.called
        # one letter of another kind, in a read too short for a k-mer, takes the way of texts
        assert found == S.unitigs([*reads, "R"], options)


def test_mean_phred_from_bytes(spark):
    from genospark.functions import sequence as S

    rows = ["!!", "I", "", None, "#5I~", "é5"]
    frame = spark.createDataFrame([(k, q) for k, q in enumerate(rows)], "id int, qual string").coalesce(1)
    column = S.mean_phred()
    wanted = [sum(ord(c) - 33 for c in q) / len(q) if q else 0.0 for q in rows]
    assert [r["m"] for r in frame.select("id", column.alias("m")).orderBy("id").collect()] == wanted
    assert [r["m"] for r in frame.where("id < 5").select("id", column.alias("m")).orderBy("id").collect()] == wanted[:5]
    assert "transform" not in str(column)


def test_words_are_found_without_a_list_of_hits(spark):
    from pyspark.sql import functions as F

    from genospark.functions import motif as M

    texts = ["The end", "often", "thé of", "ofof", "x and", None, "", "ÀThe the", "İthe of"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    for options in ({}, {"ignore_case": True}, {"whole_words": True}, {"ignore_case": True, "whole_words": True}):
        found = frame.select(M.holds_motif(F.col("text"), ("and", "the", "of"), **options).alias("a"), (F.size(M.motif_hits(F.col("text"), ("and", "the", "of"), **options)) > 0).alias("b"))
        assert all(r["a"] == r["b"] for r in found.collect())


def test_correction_packs_kmers(spark):
    """Against one read at a time in plain Python: copies, N, letters of other kinds, short and missing reads, words of k below and above 31."""
    import random
    from collections import Counter

    from genospark.functions.sequence import reverse_complement
    from genospark.operators import correct

    rnd = random.Random(6)
    genome = "".join(rnd.choice("ACGT") for _ in range(300))
    texts = []
    for n in range(240):
        read = list(genome[(p := rnd.randrange(250)) : p + 50])
        for _ in range(rnd.choice([0, 0, 1, 2])):
            read[rnd.randrange(len(read))] = rnd.choice("ACGTNRé\n")
        texts.append("".join(read).lower() if n % 9 == 0 else "".join(read))
    texts += [texts[1]] * 5 + ["", None, "ACG", "GATTACA" * 9, "R" * 40, "R" * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "name long, seq string").withColumn("qual", F.lit(None).cast("string"))
    turned = {s: t for s, t in frame.select(F.upper("seq").alias("s"), reverse_complement(F.upper("seq"))).distinct().collect() if s}
    for k in (1, 5, 11, 31, 33):
        cut = lambda s, t: [min(s[a : a + k], t[len(s) - k - a : len(s) - a]) for a in range(len(s) - k + 1)]  # noqa: B023, E731
        canonical = lambda s: cut(s, "".join({"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}.get(c, " ") for c in reversed(s)))  # noqa: B023, E731
        upper = [(t or "").upper() for t in texts]
        assert all(canonical(s) == cut(s, turned[s]) for s in upper if s)
        counts = Counter(m for s in upper for m in canonical(s) if "N" not in m)
        model = correct.train(correct.checked(frame), k, 2)
        solid = {m for m, n in counts.items() if n >= model.min_cov}
        assert model.solid.count() == len(solid)

        def fixed(s):
            ok, at = [m in solid for m in canonical(s)], {}
            for a in range(len(ok)):
                for side, place in ((a - 1, a + k - 1), (a + 1, a)):
                    if not ok[a] and 0 <= side < len(ok) and ok[side]:
                        new = [(b, s[a:place] + b + s[place + 1 : a + k]) for b in "ACGT" if b != s[place]]
                        at.setdefault(place, set()).update(b for b, m in new if canonical(m)[0] in solid)
            return "".join(next(iter(at[p])) if len(at.get(p, ())) == 1 else c for p, c in enumerate(s))

        found = correct.correct(frame, model, 2)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()  # no read is sent for a few changes
        assert [r["seq"] or "" for r in found.orderBy("name").collect()] == [fixed(fixed(s)) for s in upper]
        left = {r["name"] for r in correct.unique_only(frame.withColumn("seq", F.upper("seq")), model).select("name").collect()}
        assert left == {n for n, s in enumerate(upper) if all(m in solid for m in canonical(s))}


def test_packed_kmers_of_long_sequences(spark):
    from unittest import mock

    from genospark.operators import kmers as K

    text = "ACGTTGCAACNNGATTACAGATTTGC" * 40
    with mock.patch.object(K, "CHUNK", 100):
        pieces = [p for cut in K._cut([None, "AC", text, text[:200]], 7) for p in cut]
        chunks = [K._packed_chunk(cut, 7) for cut in K._cut([None, "AC", text, text[:200]], 7)]
    assert max(len(p[2]) for p in pieces) == 106
    got = [(int(r), int(a), K._as_bytes(c[n : n + 1], 7)[0].as_py()) for c, rows, places, _ in chunks for n, (r, a) in enumerate(zip(rows, places))]
    assert got == [(r, a, m) for r, t in ((2, text), (3, text[:200])) for a, m in K._spelled(t, 7)]


def test_reads_over_regions_make_no_pairs(spark):
    """Against brute force: sparse, dense, wide and touching regions, block borders, missing chromosomes, equal rows."""
    import random

    from genospark.operators import intervals as I

    rnd = random.Random(8)
    for reach, n in ((3_000, 300), (60_000, 60), (40_000_000, 20)):
        regions = [(k, rnd.choice([0, 1, None]), p := rnd.randrange(reach), p + rnd.choice([0, 1, 40, 1_023, 5_000])) for k in range(n)]
        reads = [(f"r{k // 2}", rnd.choice([0, 4]), rnd.choice([0, 1, 2, None]), rnd.randrange(reach), "32M", rnd.choice([0, 1, 2]), rnd.randrange(reach), 32) for k in range(300)]
        reads += reads[:20] + [("b", 0, c, q + d, "32M", 1, 5, 32) for _, c, q, _ in regions[:20] for d in (-33, -32, 0, 1)]
        a = spark.createDataFrame(reads, "qname string, flag int, tid int, pos int, cigar string, mtid int, mpos int, l_qseq int")
        b = spark.createDataFrame(regions, "id long, chr int, pos1 int, pos2 int")
        hit = lambda c, p, e: c is not None and any(c == x and p <= s2 and s1 <= e for _, x, s1, s2 in regions)  # noqa: B023, E731
        own = [hit(r[2], r[3], r[3] + (1 if r[1] & 4 else 32)) for r in reads]
        mate = [hit(r[5], r[6], r[6] + 32) for r in reads]
        key = lambda rows: sorted(map(str, map(tuple, rows)))
        assert key(I.overlapping_reads(a, b).collect()) == key(r for r, o in zip(reads, own) if o)
        assert key(I.overlapping_reads(a, b, anti=True).collect()) == key(r for r, o in zip(reads, own) if not o)
        assert key(I.overlapping_reads(a, b, mate_linked=True).collect()) == key(r for r, o, m in zip(reads, own, mate) if o or m)
    assert "cell" not in I.overlapping_reads(a, b)._jdf.queryExecution().optimizedPlan().toString()


def test_large_keys_equal_duckdb(spark, large_keys):
    """Queries that overflowed, against their SQL with the product in 128 bits."""
    import duckdb

    from genospark.plans.catalog import ORACLES
    from genospark.plans.fixtures import _PRODUCT

    folder, _ = large_keys
    root = folder.removeprefix("file://")
    spark.range(300).selectExpr("id + 5900000 event_id", "id * 7 user_id", "element_at(array('view', 'click', 'error'), cast(id % 3 + 1 as int)) event_type").write.parquet(f"{folder}/events.parquet")
    duck = duckdb.connect()
    for name, files in (("lineitem", "lineitem.parquet/*.parquet"), ("events", "events.parquet/*.parquet"), ("nation", "nation.parquet")):
        duck.execute(f"create view {name} as select * from '{root}/{files}'")
    for name in ("bedgraph", "cigar_align_pos", "cigar_reversed", "count_contained", "depth_max", "depth_runs_inclusive", "distinct_region_scan", "filter_auto_includer"):
        sql = ORACLES[name].replace(_PRODUCT, "cast((cast(h as hugeint) * 2654435761) & 4294967295 as bigint)")
        assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == sorted(duck.execute(sql).fetchall()), name


def test_count_contained_makes_no_pairs(spark):
    """Against brute force: narrow, wide, nested, equal and reversed intervals, signed bounds to the ends of 32 bits, missing values, ids of two rows."""
    import random
    from collections import Counter

    from genospark.operators import intervals as I

    rnd = random.Random(9)
    schema = "id long, chr int, pos1 int, pos2 int, strand string"
    for reach in (40, 5_000, 2_100_000_000):

        def table(n: int, widths: list[int]) -> list[tuple]:
            starts = [rnd.randrange(-reach // 2, reach) for _ in range(n)]
            ends = [None if rnd.random() < 0.03 else min(p + rnd.choice(widths), (1 << 31) - 1) for p in starts]
            return [(k // 2, rnd.choice([0, 1, None]), None if rnd.random() < 0.03 else p, e, "*") for k, (p, e) in enumerate(zip(starts, ends))]

        ends = (-(1 << 31), (1 << 31) - 1)
        asked = table(150, [0, 1, 5, 40, 1_000, -3]) + [(None, 0, -5, 50, "*"), (999, 0, *ends, "*")]
        held = table(300, [0, 1, 2, 7, 33, 64, 1_025, 70_000, reach // 2])
        held += held[:40] + [(1, 0, *ends, "*"), (1, 0, ends[0], ends[0], "*")]
        wanted = Counter({q[0]: 0 for q in asked})
        for q in (q for q in asked if None not in q[1:4] and q[2] <= q[3]):
            wanted[q[0]] += sum(1 for s in held if None not in s[1:4] and s[1] == q[1] and s[2] >= q[2] and s[3] <= q[3])
        found = I.count_contained(*[spark.createDataFrame(t, schema) for t in (asked, held)])
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted.items()))
    assert "cell" not in found._jdf.queryExecution().optimizedPlan().toString()
    none = spark.createDataFrame([], schema)
    assert I.count_contained(none, found.select(F.lit(1).alias("id"), F.lit(0).alias("chr"), F.lit(1).alias("pos1"), F.lit(2).alias("pos2"))).count() == 0
    assert I.count_contained(spark.createDataFrame([(7, 0, 1, 9, "*")], schema), none).collect() == [(7, 0)]


def test_sweeps_read_their_events_once(spark):
    """Twice the table, for starts and ends, and not once more for the totals of blocks; rows without a place stay away."""
    from genospark.operators import intervals as I

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("bedgraph", "depth_max", "depth_runs", "depth_runs_inclusive"):
            plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("[l_orderkey") == 2 and "ReusedExchange" in plan, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    events = spark.createDataFrame([(0, 5, 1), (0, 9, -1), (None, 5, 1), (0, None, 1)], "chr int, p long, v int")
    assert sorted(map(tuple, I.swept(events, "v").collect())) == [(0, 5, 9, 1), (0, 9, None, 0)]

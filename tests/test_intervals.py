import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from genospark.operators import intervals as I
from genospark.schema import REGION


def table(spark, rows):
    return spark.createDataFrame([(i, c, a, b, s) for i, (c, a, b, s) in enumerate(rows)], REGION)


def test_merge_golden(spark):
    rows = [(23, 10, 100, "*"), (23, 20, 110, "*"), (2, 10, 100, "*"), (2, 20, 110, "*"), (2, 200, 310, "*")]
    for merged in (I.merged(table(spark, rows)), I.merged_at_scale(table(spark, rows), 4)):
        assert sorted(map(tuple, merged.collect())) == [(2, 10, 110), (2, 200, 310), (23, 10, 110)]


def naive(q, s):
    return sorted((i, j, max(a[1], b[1]), min(a[2], b[2])) for i, a in enumerate(q) for j, b in enumerate(s) if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])


def test_join_of_all_widths(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for _ in range(n):
            start = rng.randrange(-5000, 300_000_000)
            out.append((rng.randrange(2), start, start + rng.choice([0, 3, 900, 1024, 1025, 70_000, 5_000_000, 200_000_000]), "*"))
        return out

    q, s = some(120), some(150)
    found = I.overlap_join(table(spark, q), table(spark, s))
    assert sorted(map(tuple, found.select("query_id", "subject_id", "pos1", "pos2").collect())) == naive(q, s)


regions = st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 60), st.integers(0, 30)).map(lambda t: (t[0], t[1], t[1] + t[2], "*")), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(regions, regions)
def test_properties(spark, q, s):
    a, b = table(spark, q), table(spark, s)
    assert sorted(map(tuple, I.overlap_join(a, b).select("query_id", "subject_id", "pos1", "pos2").collect())) == naive(q, s)
    cover = {(c, p) for c, x, y, _ in q for p in range(x, y + 1)}
    once = I.merged(a)
    assert sum(r["pos2"] - r["pos1"] + 1 for r in once.collect()) == len(cover)
    assert sorted(map(tuple, I.merged(once).collect())) == sorted(map(tuple, once.collect()))
    less = cover - {(c, p) for c, x, y, _ in s for p in range(x, y + 1)}
    assert {(r["chr"], p) for r in I.difference(a, b).collect() for p in range(r["pos1"], r["pos2"] + 1)} == less
    spans = a.selectExpr("chr", "pos1 as start", "pos2 + 1 as end")
    assert sum((r["end"] - r["start"]) * r["depth"] for r in I.depth_runs(spans).collect()) == sum(y - x + 1 for _, x, y, _ in q)


def test_tiles(spark):
    one = table(spark, [(0, 1, 1000, "*")])
    got = [tuple(r)[2:] for r in I.tiles(one, 300, 50).orderBy("pos1").collect()]
    assert got == [(1, 301), (251, 551), (501, 801), (751, 1000)]
    assert [tuple(r)[2:] for r in I.tiles(one, 5000, 0).collect()] == [(1, 1000)]
    with pytest.raises(ValueError):
        I.tiles(one, 5, 5)


def test_stretch(spark):
    rows = table(spark, [(0, 10, 20, "*"), (0, 50, 60, "*"), (1, 5, 9, "*")])
    assert [r["pos2"] for r in I.stretched_right(rows, 100).orderBy("chr", "pos1").collect()] == [49, 4, 100]
    assert [r["pos1"] for r in I.stretched_left(rows, 0, True).orderBy("chr", "pos2").collect()] == [0, 21, 0]
    with pytest.raises(Exception, match="beyond"):
        I.stretched_right(rows, 7).collect()
    with pytest.raises(Exception, match="before"):
        I.stretched_left(rows, 11, True).collect()


def test_empty(spark):
    none = table(spark, [])
    assert I.overlap_join(none, none).count() == 0 and I.merged(none).count() == 0
    assert I.total_width(none).first()[0] == 0


def test_share_subject_and_contained(spark):
    a, b = table(spark, [(0, 1, 5, "*")]), table(spark, [(0, 8, 9, "*")])
    subject = table(spark, [(0, 4, 8, "*"), (0, 2, 3, "+")])
    assert I.share_subject(a, b, subject).count() == 1
    assert [tuple(r) for r in I.contained(a, subject).collect()] == [(0, 1)]
    assert I.overlap_width(a, subject).first()["width"] == 4


def test_queries_over_all_regions(spark):
    from genospark.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    assert QUERIES["overlap_same_interval_all"](spark, folder).where("id_a % 7 <> 0").count() > 0
    assert QUERIES["multi_region_scan_all"](spark, folder).where("region_id >= 50").count() > 0
    assert QUERIES["concat_regions_all"](spark, folder).where("id is null").count() == 6000
    from genospark.plans.fixtures import Fixtures

    t = Fixtures(spark, folder)
    assert QUERIES["intersection_all"](spark, folder).count() > I.intersection(t.regions, t.regions.where("id % 5 = 0")).count()
    assert QUERIES["region_semi_matelink_all"](spark, folder).count() > I.overlapping_reads(t.reads, t.regions.where("id % 3 = 0"), mate_linked=True).count()

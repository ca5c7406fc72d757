import random
import zlib

from genospark.llm import sharding


def test_maps():
    rng = random.Random(1)
    weight = [rng.randrange(0, 1000) for _ in range(4096)]
    first = sharding.first_map(4096, 40)
    edited = sharding.rebalanced(first, weight, 40)
    load = [sum(w for w, s in zip(weight, edited) if s == k) for k in range(40)]
    assert max(load) - min(load) <= 60  # of 51,000
    assert sum(a != b for a, b in zip(first, edited)) < 600  # few slots move
    more = sharding.grown(edited, weight, 40)
    assert all(a == b or b == 40 for a, b in zip(edited, more))
    new = sum(w for w, s in zip(weight, more) if s == 40)
    assert 0.9 * sum(weight) / 41 <= new <= sum(weight) / 41


def test_one_giant_slot_and_nothing():
    assert sharding.rebalanced([0, 0, 0], [100, 1, 1], 2) in ([0, 1, 1], [1, 0, 0])
    assert sharding.rebalanced([], [], 3) == []


def test_shards(spark):
    rows = [(i, "x" * (i % 97), "c") for i in range(400)] + [(7, "same", "c")] * 5 + [(None, None, None)] * 3 + [(900, "", ""), (901, "é" * 3000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_by_bytes(docs.select("doc_id", "text"), 8, n_slots=256).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(8))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    load = [sum(r["size"] for r in own) for own in by.values()]
    assert max(load) - min(load) < 6016
    assert sharding.shard_by_bytes(docs.select("doc_id", "text").limit(0), 8).count() == 0


def test_stored_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    sharding.shard_by_bytes(docs, 4, n_slots=64, store=str(tmp_path / "map")).collect()
    stored = spark.read.parquet(str(tmp_path / "map"))
    assert {r["version"]: r["count"] for r in stored.groupBy("version").count().collect()} == {1: 64, 2: 64}


def test_stored_map_is_read_and_edited(spark, tmp_path):
    store = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * i) for i in range(300)], "doc_id long, text string")
    sharding.shard_by_bytes(docs, 4, n_slots=64, store=store).collect()
    version, second = sharding.stored_map(spark, store)
    more = docs.unionByName(spark.createDataFrame([(1000 + i, "y" * 700) for i in range(150)], docs.schema))
    got = sharding.shard_by_bytes(more, 4, n_slots=64, store=store).collect()
    again, third = sharding.stored_map(spark, store)
    assert (version, again) == (2, 3) and second != third and sum(a != b for a, b in zip(second, third)) < 40
    assert {r["virtual_slot"]: r["shard"] for r in got}.items() <= dict(enumerate(third)).items()
    sharding.shard_by_bytes(more, 4, n_slots=64, store=store).collect()
    assert sharding.stored_map(spark, store)[0] == 3  # level already
    sharding.store_map(spark, store, sharding.grown(third, [1] * 64, 4))
    assert max(sharding.stored_map(spark, store)[1]) == 4


def test_a_record_repeated_beyond_a_shard(spark):
    docs = spark.createDataFrame([(5, "same text")] * 3000 + [(None, None)] * 1500 + [(i, f"text {i}") for i in range(1500)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 10, n_slots=256).collect()
    load, slots, weight = [0] * 10, [[] for _ in range(10)], [0] * 256
    for r in got:
        load[r["shard"]] += r["size"]
        weight[r["virtual_slot"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(load) - min(load) < min(w for w in weight if w) and all(sorted(s) == list(range(len(s))) for s in slots)

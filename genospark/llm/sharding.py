"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes to one of thousands of virtual slots, for ever. Bytes are summed per slot; a map gives each slot a shard. Version 1
deals slots out in turn; a rebalancing reads the newest stored version, moves single slots from heavy to light shards, so few records
move, and stores the next version. The map has one row per slot and version, whatever the size of the table, so it may be held by the
driver and broadcast. A record repeated so often that one slot could not hold its rows is dealt out over all slots row by row.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch

SLOTS = 8192


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def _exchange(heavy: list[int], light: list[int], weight: list[int], gap: int) -> tuple[int | None, int | None]:
    """The slots of two shards whose exchange moves nearest to half the gap, more than nothing and less than all of it; else nothing."""
    order = sorted(light, key=lambda s: (weight[s], s))
    weights, best = [weight[s] for s in order], None
    for slot in heavy:
        at = bisect.bisect_left(weights, weight[slot] - gap / 2)
        for k in range(max(at - 1, 0), min(at + 1, len(order))):
            moved = weight[slot] - weights[k]
            if 0 < moved < gap:
                best = min(best or (gap, 0, 0), (abs(gap - 2 * moved), slot, order[k]))
    return best[1:] if best else (None, None)


def rebalanced(shard_of: list[int], weight: list[int], n_shards: int) -> list[int]:
    """``shard_of`` edited until all shards differ by less than the lightest slot, or until neither moving one slot of a heavy shard nor
    exchanging it for a lighter one brings that shard and the lightest one nearer to each other."""
    before, shard_of, load = shard_of, list(shard_of), [0] * n_shards
    lightest = min((w for w in weight if w), default=0)
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].append(slot)
    heavy, settled = [(-b, s) for s, b in enumerate(load)], set()
    heapq.heapify(heavy)
    while heavy:
        negative, shard = heapq.heappop(heavy)
        if -negative != load[shard] or shard in settled:
            continue
        low = min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[shard] - load[low]
        fits = [s for s in held[shard] if weight[s] < gap]
        given, back = (min(fits, key=lambda s: (abs(gap - 2 * weight[s]), s)), None) if fits else (None, None)
        if given is None and gap >= lightest:
            given, back = _exchange(held[shard], held[low], weight, gap)
        if given is None:
            settled.add(shard)  # a gap to the lightest shard never widens for it; other partners get their turn in the next pass
            continue
        for slot, source, target in ((given, shard, low), (back, low, shard)):
            if slot is not None:
                held[source].remove(slot)
                held[target].append(slot)
                shard_of[slot] = target
        change = weight[given] - (0 if back is None else weight[back])
        for s, d in ((shard, -change), (low, change)):
            load[s] += d
            settled.discard(s)
            heapq.heappush(heavy, (-load[s], s))
    return shard_of if shard_of == list(before) else rebalanced(shard_of, weight, n_shards)


def grown(shard_of: list[int], weight: list[int], n_shards: int) -> list[int]:
    """``shard_of`` with shard number ``n_shards`` added: it takes slots from the heaviest shards, and no other slot moves."""
    shard_of, load = list(shard_of), [0] * n_shards
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
    goal, got = sum(load) / (n_shards + 1), 0
    for slot in sorted(range(len(shard_of)), key=lambda s: (-weight[s], s)):
        shard = shard_of[slot]
        if weight[slot] and got + weight[slot] <= goal and load[shard] - weight[slot] >= goal * 0.98:
            load[shard] -= weight[slot]
            got += weight[slot]
            shard_of[slot] = n_shards
    return shard_of


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def with_size(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with size (UTF-8 bytes of the text, null: none, plus 16) and text_crc32."""
    return df.withColumns({"size": (F.coalesce(F.octet_length(df[text]), F.lit(0)) + 16).cast("long"), "text_crc32": text_crc32(df[text])})


def with_virtual_slot(df: DataFrame, scratch: Scratch, key: str = "doc_id", n_slots: int = SLOTS) -> DataFrame:
    """``df``, which has size and text_crc32, with virtual_slot, as a written table.

    Key, checksum and size are hashed, so rows that share a null or repeated key spread out. Rows that are equal in all three are a record
    repeated; one with more than twice a slot's share of the rows is hot (at most half as many as slots, so they may be broadcast), and
    its rows are hashed with a number each, which the written table keeps.
    """
    record = [F.col(key), F.col("text_crc32"), F.col("size")]
    counted = df.groupBy(*record).agg(F.count("*").alias("n"))
    share = df.count() / n_slots
    hot = scratch.save(counted.where(F.col("n") > max(2 * share, 100)).select(F.col(key).alias("__k"), F.col("text_crc32").alias("__c"), F.col("size").alias("__s"), F.lit(True).alias("__hot")), "hot")
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("text_crc32") == F.col("__c")) & (F.col("size") == F.col("__s"))
    number = F.when(F.col("__hot"), F.monotonically_increasing_id())
    marked = df.join(F.broadcast(hot), same, "left").withColumn("virtual_slot", F.pmod(F.xxhash64(*record, number), F.lit(n_slots)).cast("int"))
    return scratch.save(marked.drop("__k", "__c", "__s", "__hot"), "slotted")


def slot_weights(df: DataFrame, n_slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: ``n_slots`` numbers each, aggregated on the executors."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in df.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def stored_map(spark: SparkSession, store: str) -> tuple[int, list[int]] | None:
    """Number and shards (by virtual slot) of the newest version in the folder ``store``; None where it holds none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    table = spark.read.schema("version int, virtual_slot int, shard int").parquet(store)
    version = table.agg(F.max("version").alias("v")).first()["v"]
    return None if version is None else (version, [r["shard"] for r in table.where(F.col("version") == version).orderBy("virtual_slot").collect()])


def store_map(spark: SparkSession, store: str, shard_of: list[int]) -> None:
    """Add ``shard_of`` to the folder ``store`` as its next version: rows version (from 1), virtual_slot, shard. Older versions stay."""
    version = (stored_map(spark, store) or (0, []))[0] + 1
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(store)


def shard_by_bytes(df: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", n_slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """All rows of ``df`` with size, text_crc32, law ('bytes'), shard, slot, grown_shard and virtual_slot.

    The size of a row is the UTF-8 bytes of its text (null: none) plus 16; shards differ in bytes by less than the lightest slot
    wherever moves and exchanges of slots can bring that about. A ``df`` with size and text_crc32 of its own needs no text. ``slot``
    numbers the rows of each shard from 0 without a gap, by virtual slot, key and checksum. ``grown_shard`` is null: growing a map balanced by bytes is an edit of its own (``grown``).
    Empty tables give no rows; repeated rows each get a slot, and any number of them leaves the shards level; columns of the same names
    are replaced. ``store``: the folder of the map's versions. Its newest one is rebalanced and the outcome added, if it differs; a folder
    without versions gets version 1 first. A map for more shards than ``n_shards`` is an error.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    store = store or f"{scratch.root}/map"
    slotted = with_virtual_slot(df if {"size", "text_crc32"} <= set(df.columns) else with_size(df, text), scratch, key, n_slots)
    size, rows = slot_weights(slotted, n_slots)
    if stored_map(spark, store) is None:
        store_map(spark, store, first_map(n_slots, n_shards))
    _, current = stored_map(spark, store)
    if len(current) != n_slots or max(current, default=0) >= n_shards:
        raise ValueError("the stored map has other numbers of slots or shards")
    edited = rebalanced(current, size, n_shards)
    if edited != current:
        store_map(spark, store, edited)
    _, newest = stored_map(spark, store)
    before, entries = [0] * n_shards, []
    for slot, shard in enumerate(newest):
        entries.append((slot, shard, before[shard]))
        before[shard] += rows[slot]
    places = spark.createDataFrame(entries, "__slot int, __shard int, __before long")
    order = Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    placed = slotted.withColumn("__rank", F.row_number().over(order)).join(F.broadcast(places), F.col("virtual_slot") == F.col("__slot"))
    return placed.withColumns(
        {"law": F.lit("bytes"), "shard": F.col("__shard"), "slot": F.col("__before") + F.col("__rank") - 1, "grown_shard": F.lit(None).cast("int")}
    ).drop("__slot", "__shard", "__before", "__rank")

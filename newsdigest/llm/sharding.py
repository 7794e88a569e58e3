"""Sharding through fixed virtual slots.

Records hash by ``doc_id`` into a fixed number of virtual slots (thousands). Bytes and rows are
aggregated per slot, so only the slot table (``SLOTS`` rows at most, a proven bound) reaches the
driver, where a versioned slot-to-shard map is built. The map is a small Parquet table with one
folder per version; rebalancing edits it by moving as few slots as it needs. Text never shuffles.

The rows of an id that repeats and is larger than two average slots are dealt over all slots instead, so
that sizes stay near equal when one id, or null, holds a third of all rows.

Defined results: a null text has no bytes; a record costs its UTF-8 bytes plus 8. Repeated rows
get places of their own. A null ``doc_id`` hashes like any other value. A very long text is one record, and its
shard is as much larger if the text is larger than a shard. Other columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import cut, numbered, shared_path, table

#: Virtual slots. Fixed for the life of a data set: records never change their slot.
SLOTS = 8192
SHARDS = 24
#: What a record costs besides its text.
RECORD_BYTES = 8

MAP_SCHEMA = T.StructType([T.StructField("vslot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False),
                           T.StructField("first_place", T.LongType(), False)])


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("vslot"))


def spread_hot(records: DataFrame, slots: int) -> DataFrame:
    """records, with the rows of hot ids dealt over all slots by text and number among their equals. Fewer than half as many ids as slots can be hot, so they are
    broadcast."""
    total = records.agg(F.sum("size")).first()[0] or 0
    hot = records.groupBy("doc_id").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("b") > 2 * total / slots))
    hot = cut(hot.select(F.col("doc_id").alias("hot_id")), "hot-ids")
    if hot.isEmpty():
        return records
    is_hot = F.col("doc_id").eqNullSafe(F.col("hot_id"))
    own = numbered(records.join(F.broadcast(hot), is_hot, "left_semi").drop("vslot"))
    own = own.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "nth"), F.lit(slots)).cast("int")).drop("nth")
    return cut(records.join(F.broadcast(hot), is_hot, "left_anti").unionByName(own), "slots")


def slot_stats(records: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows). One row per slot reaches the driver, ``SLOTS`` at most."""
    rows = records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r.vslot: (r.b, r.n) for r in rows}


def build_map(stats: Mapping[int, tuple[int, int]], shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """First version: the largest slots first, each to the shard with the fewest bytes.
    Slots without records count as empty; they are dealt too, so the map is total."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda v: (-stats.get(v, (0, 0))[0], v)):
        b, n, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (b + stats.get(slot, (0, 0))[0], n + 1, s))
    return out


def rebalance(old: Mapping[int, int], stats: Mapping[int, tuple[int, int]], shards: int,
              tolerance: float = 0.01) -> dict[int, int]:
    """The next version: slots move from the fullest shard to the emptiest until no shard is
    above the mean by more than ``tolerance`` or no single move helps. Shards that no longer
    exist are emptied first. Slots that need not move stay."""
    size = lambda v: stats.get(v, (0, 0))[0]
    new, load, held = dict(old), [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for v, s in sorted(old.items()):
        if s < shards:
            load[s] += size(v)
            held[s].append(v)
        else:
            homeless.append(v)

    def put(v, s):
        new[v] = s
        load[s] += size(v)
        held[s].append(v)

    for v in sorted(homeless, key=lambda v: (-size(v), v)):
        put(v, min(range(shards), key=lambda s: (load[s], s)))
    mean = sum(load) / shards
    for _ in range(len(new)):  # each slot moves once on average at most
        top, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[top] - load[low]
        movable = [v for v in held[top] if 0 < size(v) < gap]
        if load[top] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance) or not movable:
            break
        v = min(movable, key=lambda v: (abs(gap / 2 - size(v)), v))  # halves the gap best
        held[top].remove(v)
        load[top] -= size(v)
        put(v, low)
    return new


class SlotMap:
    """Versions of the slot-to-shard map under one path: ``version=<n>/`` folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, assigned: Mapping[int, int], stats: Mapping[int, tuple[int, int]]) -> DataFrame:
        """Write one version. ``first_place`` is where a slot's records begin in their shard."""
        placed, rows = {}, []
        for v, s in sorted(assigned.items()):
            rows.append((v, s, placed.get(s, 0)))
            placed[s] = placed.get(s, 0) + stats.get(v, (0, 0))[1]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and slot of every record. ``slot`` is the record's place in its shard, gapless from
    0: the start of its virtual slot in the shard plus its rank in the virtual slot. The map has
    one row per virtual slot, so it is broadcast."""
    rank = F.row_number().over(W.Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (records.withColumn("rank", rank).join(F.broadcast(slot_map), "vslot")
            .withColumn("slot", F.col("first_place") + F.col("rank") - 1).drop("rank", "first_place"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row of ``docs`` into a shard, sizes near equal. Returns doc_id, size, text_crc32,
    law, shard, slot, grown_shard (null under this law), vslot, map_version."""
    spark = docs.sparkSession
    records = spread_hot(cut(sized(docs, slots), "slots"), slots)
    stats = slot_stats(records)
    versions = SlotMap(spark, map_path or shared_path(spark, "slot-map"))
    slot_map = versions.store(1, build_map(stats, shards, slots), stats)
    return place(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(1).alias("map_version"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))

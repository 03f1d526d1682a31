"""Sharding over fixed virtual slots.

Records hash by their id into ``SLOTS`` virtual slots, once and for all. A versioned map says which shard holds each slot. Rebalancing edits the
map: from the bytes of each slot it moves single slots from the fullest shard to the emptiest, until no move evens them further. Only the map and
the bytes of the slots, a fixed number of rows, ever come to the driver; records move only with their slot.

Defined results: a null text has no bytes; every record counts one byte besides its text, so empty ones weigh too; records that share an id share
a slot and stand there in the order of text checksum and size; a null id hashes like any other value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import scratch_folder

SLOTS = 4096
SHARDS = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot (by slot number), in one version."""

    version: int
    shards: int
    shard: tuple[int, ...]

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, weights: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version for the given bytes of each slot. More shards begin empty and take only what evens the load; slots of shards that go
        are dealt to the emptiest."""
        count = shards or self.shards
        held: list[list[int]] = [[] for _ in range(count)]
        homeless = []
        for slot, shard in enumerate(self.shard):
            (held[shard] if shard < count else homeless).append(slot)
        weigh = lambda slot: weights.get(slot, 0)
        load = [sum(map(weigh, slots)) for slots in held]
        for slot in sorted(homeless, key=lambda s: (-weigh(s), s)):
            to = min(range(count), key=lambda k: (load[k], k))
            held[to].append(slot)
            load[to] += weigh(slot)
        while True:
            full = max(range(count), key=lambda k: (load[k], -k))
            low = min(range(count), key=lambda k: (load[k], k))
            gap = load[full] - load[low]
            # the slot nearest half the gap evens most; one as large as the gap would only swap the two shards
            moves = [s for s in held[full] if 0 < weigh(s) < gap]
            if not moves:
                break
            slot = min(moves, key=lambda s: (abs(2 * weigh(s) - gap), s))
            held[full].remove(slot)
            held[low].append(slot)
            load[full] -= weigh(slot)
            load[low] += weigh(slot)
        shard = [0] * len(self.shard)
        for k, slots in enumerate(held):
            for slot in slots:
                shard[slot] = k
        return SlotMap(self.version + 1, count, tuple(shard))

    def stored(self, spark: SparkSession, folder: str) -> None:
        """Written below ``folder`` as a version of its own; earlier versions stay readable."""
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.shard)]
        spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def loaded(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{folder}/version={version}").collect())
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slot_loads(records: DataFrame, size: str = "size", slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and records of each slot: at most ``slots`` rows, summed inside the tasks first."""
    rows = records.groupBy("virtual_slot").agg(F.sum(size), F.count("*")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def sharded(docs: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each record's virtual slot, shard and place inside its shard (``slot``, gapless from 0), under a map rebalanced for these records and stored
    below ``folder``: ``doc_id, size, text_crc32, virtual_slot, shard, slot``. Texts are read, never shuffled."""
    spark = docs.sparkSession
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint")
    records = docs.select(F.col(key).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
                          slot_of(F.col(key), slots).alias("virtual_slot"))
    loads = slot_loads(records, slots=slots)
    first = SlotMap.even(shards, slots)
    first.stored(spark, folder)
    current = first.rebalanced({s: b for s, (b, _) in loads.items()})
    current.stored(spark, folder)
    current = SlotMap.loaded(spark, folder, current.version)
    next_place = [0] * shards
    rows = []
    for slot, shard in enumerate(current.shard):
        if slot in loads:
            rows.append((slot, shard, next_place[shard]))
            next_place[shard] += loads[slot][1]
    places = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, first_place bigint"))  # `slots` rows at most
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (records.withColumn("place", F.row_number().over(within)).join(places, "virtual_slot")
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first_place") + F.col("place") - 1).alias("slot")))


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = sharded(table(spark, folder, "documents"), scratch_folder(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")

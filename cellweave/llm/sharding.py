"""Sharding by fixed virtual slots.

Records are hashed into ``n_slots`` virtual slots by their id and text checksum; rows of one id and text,
which would all meet in one slot, are hashed by their place in the input too.  Bytes and rows are summed per slot, which is all the
driver sees: ``n_slots`` rows whatever the corpus holds.  A versioned map sends slots to
shards; balancing moves slots, never single records, and stores the edited map as the next
version.  A hot id range, source or group of copies or of repeated rows is spread over all slots by the hash,
so no slot, and no window over one, is much larger than another.

A null text has no bytes; a null id hashes like any other value; repeated rows each get a
place of their own.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _runtime as R


@dataclass
class SlotMap:
    """Slot-to-shard map.  ``shards[slot]`` is the shard; ``moved`` counts slots moved by each edit."""

    shards: list[int]
    n_shards: int
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([s * n_shards // n_slots for s in range(n_slots)], n_shards)

    def loads(self, weights: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, w in weights.items():
            out[self.shards[slot]] += w
        return out

    def rebalanced(self, weights: dict[int, int], slack: float = 0.002) -> SlotMap:
        """The next version: slots leave shards over the mean, largest first, for the lightest shard.

        Slots of shards that are near the mean stay, so that an edit moves few records.
        """
        shards, load = list(self.shards), self.loads(weights)
        mean = sum(load) / self.n_shards
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, w in weights.items():
            own[shards[slot]].append((w, slot))
        free: list[tuple[int, int]] = []
        for k in range(self.n_shards):
            own[k].sort()
            while load[k] > mean * (1 + slack) and len(own[k]) > 1:
                # the largest slot that doesn't take the shard below the mean, else the smallest
                i = max((i for i, (w, _) in enumerate(own[k]) if load[k] - w >= mean), default=0)
                w, slot = own[k].pop(i)
                if i == 0 and load[k] - w < mean and mean - (load[k] - w) >= load[k] - mean:
                    own[k].insert(0, (w, slot))
                    break
                load[k] -= w
                free.append((w, slot))
        heap = [(x, k) for k, x in enumerate(load)]
        heapq.heapify(heap)
        for w, slot in sorted(free, reverse=True):
            x, k = heapq.heappop(heap)
            shards[slot] = k
            heapq.heappush(heap, (x + w, k))
        return SlotMap(shards, self.n_shards, self.version + 1, [*self.moved, sum(a != b for a, b in zip(shards, self.shards, strict=True))])

    def grown(self) -> SlotMap:
        """One more shard, which takes its share of slots and changes no other slot."""
        n = self.n_shards + 1
        take = len(self.shards) // n
        left = [self.shards.count(k) for k in range(self.n_shards)]
        shards = list(self.shards)
        order = sorted(range(len(shards)), key=lambda s: (s * 0x9E3779B97F4A7C15) % (1 << 64))
        for slot in order:
            if not take:
                break
            if left[shards[slot]] > len(shards) // n:
                left[shards[slot]] -= 1
                shards[slot] = self.n_shards
                take -= 1
        return SlotMap(shards, n, self.version + 1, [*self.moved, sum(a != b for a, b in zip(shards, self.shards, strict=True))])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, k) for s, k in enumerate(self.shards)], "map_version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the versions stored at path."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("map_version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        if version is None:
            version = rows.agg(F.max("map_version")).first()[0]
        rows = sorted((r.virtual_slot, r.shard) for r in rows.where(F.col("map_version") == version).collect())
        return cls([k for _, k in rows], max(k for _, k in rows) + 1, version)


def sized(documents: DataFrame, n_slots: int) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot; written, so that a repeated row keeps its place."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("key", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", F.lit(True).alias("repeated"))
    slot = F.when(F.col("repeated"), F.xxhash64("key", "place")).otherwise(F.col("key"))
    return R.written(rows.join(repeated, "key", "left").select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(n_slots)).cast("int").alias("virtual_slot")), "sized")


def shard(documents: DataFrame, n_shards: int = 40, n_slots: int = 16384, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (place in the shard, gapless from 0), map_version."""
    spark = documents.sparkSession
    rows = sized(documents, n_slots)
    sums = {r.virtual_slot: (r.bytes, r.rows) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    first = SlotMap.initial(n_slots, n_shards)
    slots = first.rebalanced({s: b for s, (b, _) in sums.items()})
    path = map_path or f"{R.scratch_root(spark)}/cellweave/slot-map-{id(slots):x}-{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    first.save(spark, path)
    slots.save(spark, path)
    return placed(rows, SlotMap.load(spark, path, slots.version), {s: n for s, (_, n) in sums.items()})


def placed(rows: DataFrame, slots: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Adds shard and slot: places are dealt out slot by slot, so no window is larger than a virtual slot."""
    offsets, used = [], [0] * slots.n_shards
    for s, k in enumerate(slots.shards):
        offsets.append((slots.version, s, k, used[k]))
        used[k] += counts.get(s, 0)
    table = rows.sparkSession.createDataFrame(offsets, "map_version int, virtual_slot int, shard int, first_place long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    # one row per virtual slot: n_slots bounds the broadcast
    return rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first_place") + F.col("place") - 1).alias("slot"), "map_version")

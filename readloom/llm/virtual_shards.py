"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.runtime import checkpointed

#: Virtual slots: fixed for good, so a record's slot never changes. All tables by slot have so many rows at most.
VIRTUAL_SLOTS = 4096
SHARDS = 16
#: Shards whose fullest and emptiest differ by so much of the mean are left as they are.
TOLERANCE = 0.005


def virtual_slot(doc_id: Column, text: Column) -> Column:
    """The slot of a record: depends on its id and text only, so rows without an id, or of one id, are spread too."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(VIRTUAL_SLOTS)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """shard of each virtual slot; every edit makes the next version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def dealt(n_shards: int) -> SlotMap:
        """The first map, made before any sizes are known: slots in turn."""
        return SlotMap(1, n_shards, tuple(v % n_shards for v in range(VIRTUAL_SLOTS)))

    @staticmethod
    def balanced(size_of: dict[int, int], n_shards: int) -> SlotMap:
        """Slots by falling size, each to the shard that has least so far."""
        shards = [0] * VIRTUAL_SLOTS
        heap = [(0, 0, s) for s in range(n_shards)]
        for slot in sorted(range(VIRTUAL_SLOTS), key=lambda v: (-size_of.get(v, 0), v)):
            size, n, shard = heapq.heappop(heap)
            shards[slot] = shard
            heapq.heappush(heap, (size + size_of.get(slot, 0), n + 1, shard))
        return SlotMap(1, n_shards, tuple(shards))

    def grown(self, size_of: dict[int, int]) -> SlotMap:
        """One more shard, which takes slots from the fullest shards; no slot moves between the old ones."""
        shards = list(self.shards)
        by: dict[int, list[int]] = {s: [] for s in range(self.n_shards)}
        for slot in sorted(range(VIRTUAL_SLOTS), key=lambda v: (size_of.get(v, 0), v)):
            by[shards[slot]].append(slot)
        fill = {s: sum(size_of.get(v, 0) for v in slots) for s, slots in by.items()}
        goal, taken = sum(fill.values()) / (self.n_shards + 1), 0
        while taken < goal:
            full = max(fill, key=lambda s: (fill[s], s))
            fits = [v for v in by[full] if 0 < size_of.get(v, 0) <= goal - taken]
            if not fits:
                break
            slot = fits[-1]
            by[full].remove(slot)
            fill[full] -= size_of[slot]
            taken += size_of[slot]
            shards[slot] = self.n_shards
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(shards))

    def rebalanced(self, size_of: dict[int, int], tolerance: float = TOLERANCE) -> SlotMap:
        """Slots moved one by one from the fullest to the emptiest shard until all are within tolerance of the mean, or no move helps."""
        shards = list(self.shards)
        fill = [0] * self.n_shards
        for slot, s in enumerate(shards):
            fill[s] += size_of.get(slot, 0)
        mean = sum(fill) / self.n_shards
        while (gap := max(fill) - min(fill)) > tolerance * mean:
            full, least = fill.index(max(fill)), fill.index(min(fill))
            moves = [v for v, s in enumerate(shards) if s == full and 0 < size_of.get(v, 0) < gap]
            if not moves:
                break
            slot = min(moves, key=lambda v: (abs(size_of[v] - gap / 2), v))
            shards[slot] = least
            fill[full] -= size_of[slot]
            fill[least] += size_of[slot]
        return SlotMap(self.version + 1, self.n_shards, tuple(shards))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path (one Parquet folder a version)."""
        rows = [(slot, shard, self.n_shards) for slot, shard in enumerate(self.shards)]
        spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))


def slot_sizes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """{virtual slot: (rows, bytes)}; at most VIRTUAL_SLOTS entries reach the driver."""
    return {r.virtual_slot: (r.n, r.bytes) for r in records.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}


def sharded(docs: DataFrame, n_shards: int = SHARDS, slot_map: SlotMap | None = None, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version per row of docs (doc_id, text; more are ignored).

    size: UTF-8 bytes of the text (null: none) plus 1. Law 'bytes': the shards' sizes are nearly
    equal, as slots are dealt by their bytes (a slot is never split, so a record above a shard's share,
    or as many repeats of one row, make its shard larger). slot: the row's place in its shard, gapless
    from 0, by virtual slot, doc_id and crc.

    Records are dealt by slot_map; else, with maps (a folder that all executors share), by the newest
    map there, which is edited first where these records make its shards uneven: then the edited map
    is stored as the next version. A folder without maps begins with slots dealt in turn to n_shards.
    Without either, slots are dealt by their sizes.

    Null ids are spread by their texts; repeated rows share a virtual slot and get places of their
    own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col("doc_id"), text).alias("virtual_slot"))
    records = checkpointed(records)
    stats = slot_sizes(records)
    size_of = {v: b for v, (_, b) in stats.items()}
    if slot_map is None and maps is not None:
        slot_map = stored_map(spark, maps, size_of, n_shards)
    slot_map = slot_map or SlotMap.balanced(size_of, n_shards)
    place, rows = [0] * slot_map.n_shards, []
    for slot, shard in enumerate(slot_map.shards):
        rows.append((slot, shard, place[shard]))
        place[shard] += stats.get(slot, (0, 0))[0]
    table = spark.createDataFrame(rows, "virtual_slot int, shard int, first_place long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("i", F.row_number().over(order)).join(F.broadcast(table), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_place") + F.col("i") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )


def stored_map(spark: SparkSession, maps: str, size_of: dict[int, int], n_shards: int) -> SlotMap:
    """The newest map of the folder maps, edited and stored as the next version where its shards are uneven or fewer than n_shards."""
    try:
        now = SlotMap.load(spark, maps)
    except AnalysisException:  # nothing is stored yet
        now = SlotMap.dealt(n_shards)
        now.save(spark, maps)
    while now.n_shards < n_shards:
        now = now.grown(size_of)
        now.save(spark, maps)
    edited = now.rebalanced(size_of)
    if edited.shards != now.shards:
        edited.save(spark, maps)
        return SlotMap.load(spark, maps)
    return now

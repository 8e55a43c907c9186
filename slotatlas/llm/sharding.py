"""Sharding over fixed virtual slots. Built-in functions only.

A record's slot is the hash of its id modulo a fixed number of slots; a map says which shard holds a slot. Moving data
means editing the map: `rebalance` changes as few slots as bring the shards' bytes together, and each edit is stored as
a new version. Bytes and rows are summed per slot, so what the driver sees has one row for each slot, whatever the
number of records.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
MAP = "version int, virtual_slot int, shard int, bytes long"


def measured(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """`doc_id, size, text_crc32, virtual_slot` of each row. Size: bytes in UTF-8 (none for null) plus 1."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
                     F.crc32(whole).alias("text_crc32"), F.pmod(F.xxhash64(f"`{doc_id}`"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_totals(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: one row per slot at most comes to the driver."""
    size, rows = [0] * slots, [0] * slots
    for slot, total, n in records.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[slot], rows[slot] = total, n
    return size, rows


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map before anything is known: slots dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalance(shard_of: list[int], size: list[int], shards: int, tolerance: float = 0.0005) -> list[int]:
    """The map edited so that the shards' bytes are nearly equal: within the tolerance of the mean, if slots allow.

    Shards above that give up slots, those that fit their excess best; the slots go to the lightest shards, largest
    first; then single slots move from the heaviest to the lightest shard while that brings the two closer. Slots of
    shards that are within the mean stay where they are. Empty slots never move.
    """
    out = list(shard_of)
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(out):
        if size[slot]:
            held[shard].add(slot)
            load[shard] += size[slot]
    mean = sum(size) / shards
    free = []
    for shard in [s for s in range(shards) if load[s] > mean * (1 + tolerance)]:
        for slot in sorted(held[shard], key=lambda s: (-size[s], s)):
            if load[shard] - size[slot] >= mean or (load[shard] > mean and len(held[shard]) > 1 and size[slot] <= 2 * (load[shard] - mean)):
                held[shard].remove(slot)
                load[shard] -= size[slot]
                free.append(slot)
    lightest = [(load[s], s) for s in range(shards)]
    heapq.heapify(lightest)
    for slot in sorted(free, key=lambda s: (-size[s], s)):
        _, shard = heapq.heappop(lightest)
        held[shard].add(slot)
        load[shard] += size[slot]
        out[slot] = shard
        heapq.heappush(lightest, (load[shard], shard))
    for _ in range(len(size)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        slot = min(held[high], key=lambda s: (abs(gap - 2 * size[s]), s), default=None)
        if gap <= tolerance * mean or slot is None or size[slot] >= gap:
            break
        held[high].remove(slot)
        held[low].add(slot)
        load[high], load[low] = load[high] - size[slot], load[low] + size[slot]
        out[slot] = low
    return out


class SlotMap:
    """Versions of a slot-to-shard map below a shared path. Versions are only added, so readers keep theirs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], MAP).write.mode("ignore").parquet(path)

    def _table(self) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(self.path)

    def latest(self) -> int:
        """Number of the newest version, 0 if there is none."""
        return self._table().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def store(self, shard_of: list[int], size: list[int]) -> int:
        """Add a version and return its number."""
        version = self.latest() + 1
        rows = [(version, slot, shard, size[slot]) for slot, shard in enumerate(shard_of)]
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(self.path)
        return version

    def load(self, version: int) -> list[int]:
        """Shard of each slot: one row per slot."""
        return [shard for _, shard in sorted(map(tuple, self._table().where(F.col("version") == version).select("virtual_slot", "shard").collect()))]


def looked_up(values: list[int], index: Column, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), index + 1)


def place(records: DataFrame, shard_of: list[int], rows: list[int]) -> DataFrame:
    """Add `shard` and `slot`, the place in the shard: gapless from 0.

    Places run through the virtual slots of a shard in turn; only inside one virtual slot are rows numbered by a window.
    """
    first, filled = [], {}
    for slot, shard in enumerate(shard_of):
        first.append(filled.get(shard, 0))
        filled[shard] = first[-1] + rows[slot]
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumns({"shard": looked_up(shard_of, F.col("virtual_slot"), "int"),
                                "slot": looked_up(first, F.col("virtual_slot"), "bigint") + number})

"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; one pass adds up bytes and rows of each slot; a versioned
slot-to-shard map is packed from those sums and written as a table. Rebalancing and adding a shard edit the map into a
new version and move whole slots; records are never hashed anew. The map has VIRTUAL_SLOTS rows at any corpus size.

Defined results: a null id hashes as an empty string; a null text has 16 bytes; repeated rows are separate records of
one slot; an empty table gives an empty result (and a map whose slots hold nothing).
"""

from __future__ import annotations

import contextlib
import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline.llm.base import persist, work_dir

VIRTUAL_SLOTS, SHARDS, ROW_OVERHEAD = 8192, 40, 16


@dataclass
class SlotMap:
    """Slot-to-shard assignments by version; the last is in force."""

    shards: int
    versions: list[list[int]] = field(default_factory=list)

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def pack(self, sizes: list[int]) -> SlotMap:
        """A first version: the largest slot goes to the lightest shard, again and again."""
        heap, out = [(0, s) for s in range(self.shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            load, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (load + sizes[slot], shard))
        self.versions.append(out)
        return self

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.current):
            out[shard] += sizes[slot]
        return out

    def rebalance(self, sizes: list[int], tolerance: float = 0.01) -> SlotMap:
        """A new version: slots move from the heaviest shard to the lightest while that narrows the gap."""
        out, loads = list(self.current), self.loads(sizes)
        slots: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, shard in enumerate(out):
            slots[shard].append(slot)
        mean = sum(loads) / max(1, self.shards)
        for _ in range(len(out)):
            high, low = max(range(self.shards), key=loads.__getitem__), min(range(self.shards), key=loads.__getitem__)
            gap = loads[high] - loads[low]
            fits = [s for s in slots[high] if 0 < sizes[s] < gap]
            if gap <= tolerance * mean or not fits:
                break
            slot = min(fits, key=lambda s: (abs(gap - 2 * sizes[s]), s))
            slots[high].remove(slot)
            slots[low].append(slot)
            out[slot] = low
            loads[high] -= sizes[slot]
            loads[low] += sizes[slot]
        self.versions.append(out)
        return self

    def add_shard(self, sizes: list[int]) -> SlotMap:
        """A new version with one more shard, which takes slots from the heaviest shards; no other slot moves."""
        out, loads = list(self.current), [*self.loads(sizes), 0]
        goal = sum(loads) / (self.shards + 1)
        heap = [(-load, s) for s, load in enumerate(loads[:-1])]
        heapq.heapify(heap)
        slots: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot in sorted(range(len(out)), key=lambda k: (sizes[k], -k)):
            slots[out[slot]].append(slot)
        while heap and loads[-1] < goal:
            load, shard = heapq.heappop(heap)
            while slots[shard] and not sizes[slots[shard][-1]]:
                slots[shard].pop()
            if not slots[shard]:
                continue
            slot = slots[shard].pop()
            if loads[-1] + sizes[slot] <= goal * 1.01 or not loads[-1]:
                out[slot] = self.shards
                loads[-1] += sizes[slot]
                load += sizes[slot]
            heapq.heappush(heap, (load, shard))
            if not any(slots.values()):
                break
        self.shards += 1
        self.versions.append(out)
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the versions that the table at path doesn't have yet; earlier ones are never changed."""
        done = 0
        with contextlib.suppress(AnalysisException):  # no table yet
            done = spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
        rows = [(v, slot, shard) for v, version in enumerate(self.versions, 1) if v > done for slot, shard in enumerate(version)]
        if rows:
            spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        """All versions of a stored map, a fixed number of rows each."""
        rows = spark.read.parquet(path).orderBy("version", "vslot").collect()
        versions: dict[int, list[int]] = {}
        for r in rows:
            versions.setdefault(r["version"], []).append(r["shard"])
        return cls(max((r["shard"] for r in rows), default=-1) + 1, list(versions.values()))


def slot_of(id_column, text_crc32, slots: int = VIRTUAL_SLOTS):
    """The virtual slot of a record, a function of its id and its text's checksum, so that rows without an id, or many
    rows of one id, spread over the slots as far as their texts differ."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("")), text_crc32.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot); the text itself goes no further than the scan."""
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit("").cast("binary"))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(raw).alias("text_crc32"), slot_of(docs[id_col], F.crc32(raw), slots).alias("vslot"))


def slot_totals(records: DataFrame, slots: int = VIRTUAL_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: as many rows as there are slots come to the driver."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["b"], r["n"]
    return size, rows


def shard(docs: DataFrame, shards: int | None = None, slots: int | None = None, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Each record's shard under the law of near-equal bytes, and its place in the shard, gapless from 0.

    The map is stored at map_path (by default in the shared work folder). A map found there is rebalanced for these
    records, so that few of them change their shard. It also says how many slots and shards there are (SHARDS and
    VIRTUAL_SLOTS without one): more shards than it has are added one by one; fewer, or another number of slots, are a
    ValueError.

    Places are counted per virtual slot and shifted by the rows of the shard's earlier slots, so no task ever holds
    a whole shard.
    """
    spark = docs.sparkSession
    slot_map = None
    if map_path:
        with contextlib.suppress(AnalysisException):  # no map yet
            slot_map = SlotMap.load(spark, map_path)
    if slot_map and slots not in (None, len(slot_map.current)):
        raise ValueError(f"the map at {map_path} has {len(slot_map.current)} slots, not {slots}")
    if slot_map and shards is not None and shards < slot_map.shards:
        raise ValueError(f"the map at {map_path} has {slot_map.shards} shards, more than {shards}")
    slots = len(slot_map.current) if slot_map else slots or VIRTUAL_SLOTS
    records = persist(sized(docs, id_col, text_col, slots), "shard-records")
    size, rows = slot_totals(records, slots)
    if slot_map:
        while slot_map.shards < (shards or 0):
            slot_map.add_shard(size)
    else:
        slot_map = SlotMap(shards or SHARDS).pack(size)
    slot_map.rebalance(size)
    slot_map.save(spark, map_path or f"{work_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    shards = slot_map.shards
    begun, offsets = [0] * shards, []
    for slot, where in enumerate(slot_map.current):
        offsets.append((slot, where, begun[where]))
        begun[where] += rows[slot]
    plan = spark.createDataFrame(offsets, "vslot int, shard int, begun long")  # VIRTUAL_SLOTS rows, whatever the corpus
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        records.withColumn("place", place).join(F.broadcast(plan), "vslot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begun") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
    )

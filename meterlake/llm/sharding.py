"""Sharding by fixed virtual slots.

Every record is hashed into one of ``n_slots`` virtual slots.  Bytes are summed per slot, and a
versioned slot-to-shard map (one row a slot, so its size never depends on the data) says where each
slot lives.  The map is a stored table: the first version deals slots round robin, and rebalancing edits the latest
version into the next one: it moves whole slots and leaves the hash alone.  Records are placed by the map as it is read back.

Defined results
---------------
* null text: 0 bytes, so the record's size is the overhead alone; crc32 of no bytes is 0.
* the slot follows from id and text, so many records of one id, or without one, still spread over the slots.
* repeated rows: each is placed and numbered on its own.
* empty table: an empty result; the map's new version moves nothing.
* ties (equal id, size and crc): numbered in any order.
* extra columns never clash: only the id and the text are read.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from .common import materialize, shared_dir

#: Bytes that a record takes besides its text.
OVERHEAD = 16
SLOTS = 16384
#: Parts in which a slot's records are numbered.
PARTS = 8


@dataclass
class SlotMap:
    """Slot ``i`` lives in shard ``shard_of[i]``; ``version`` counts the edits."""

    n_shards: int
    shard_of: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def balanced(cls, n_shards: int, slot_bytes: dict[int, int], n_slots: int = SLOTS) -> SlotMap:
        """Largest slot first, each to the shard with fewest bytes (ties: fewest slots, lowest shard)."""
        heap = [(0, 0, s) for s in range(n_shards)]
        shard_of = [0] * n_slots
        for slot in sorted(range(n_slots), key=lambda i: (-slot_bytes.get(i, 0), i)):
            size, count, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (size + slot_bytes.get(slot, 0), count + 1, shard))
        return cls(n_shards, shard_of)

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += slot_bytes.get(slot, 0)
        return out

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.01) -> SlotMap:
        """A new version: slots move from the fullest to the emptiest shard while that helps."""
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shard_of):
            if slot_bytes.get(slot, 0):
                own[shard].append((slot_bytes[slot], slot))
        for slots in own:
            slots.sort()
        moved, goal = [], sum(loads) / max(1, self.n_shards)
        while True:
            full, empty = max(range(self.n_shards), key=loads.__getitem__), min(range(self.n_shards), key=loads.__getitem__)
            gap = loads[full] - loads[empty]
            fitting = [x for x in own[full] if x[0] < gap]
            if gap <= tolerance * goal or not fitting:
                break
            size, slot = min(fitting, key=lambda x: (abs(x[0] - gap / 2), x[1]))
            own[full].remove((size, slot))
            own[empty].append((size, slot))
            loads[full], loads[empty] = loads[full] - size, loads[empty] + size
            shard_of[slot] = empty
            moved.append(slot)
        return SlotMap(self.n_shards, shard_of, self.version + 1, moved)

    def grow(self, slot_bytes: dict[int, int]) -> SlotMap:
        """A new version with one more shard, which takes slots from the others and gives none."""
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        new, goal, taken, moved = self.n_shards, sum(loads) / (self.n_shards + 1), 0, []
        for slot in sorted(range(len(shard_of)), key=lambda i: (-slot_bytes.get(i, 0), i)):
            size, shard = slot_bytes.get(slot, 0), shard_of[slot]
            if size and taken + size <= goal and loads[shard] - size >= goal * 0.99:
                loads[shard] -= size
                taken += size
                shard_of[slot] = new
                moved.append(slot)
        return SlotMap(self.n_shards + 1, shard_of, self.version + 1, moved)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, s, self.n_shards, self.version) for i, s in enumerate(self.shard_of)],
            "vslot int, shard int, n_shards int, version int",
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map table; earlier versions stay for readers of older layouts."""
        self.rows(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        df = spark.read.parquet(path)
        at = version or df.agg(F.max("version")).first()[0]
        rows = sorted(df.filter(F.col("version") == at).select("vslot", "shard", "n_shards").collect())
        return cls(rows[0][2], [r[1] for r in rows], at)


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """Narrow rows (id, size, text_crc32, vslot); the text goes no further than this scan."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("part"),
    ).withColumn("vslot", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_stats(narrow: DataFrame) -> DataFrame:
    """Rows and bytes of each slot and part: at most ``PARTS`` rows a slot, summed map-side first."""
    return narrow.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def next_version(spark: SparkSession, path: str, n_shards: int, n_slots: int, slot_bytes: dict[int, int]) -> SlotMap:
    """The stored map, rebalanced and stored as a new version; where there is none, one is stored first."""
    try:
        now = SlotMap.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        now = SlotMap.balanced(n_shards, {}, n_slots)
        now.save(spark, path)
    if (now.n_shards, len(now.shard_of)) != (n_shards, n_slots):
        raise ValueError(f"the stored map has {now.n_shards} shards and {len(now.shard_of)} slots")
    now.rebalance(slot_bytes, 0.001).save(spark, path)
    return SlotMap.load(spark, path)


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS,
    map_path: str | None = None) -> DataFrame:
    """Place every record: near-equal bytes per shard, and its number within its shard.

    ``map_path`` holds the versions of the slot map (by default a new table in the shared folder).  Only bytes per slot
    (``n_slots`` rows at most) reach the driver.  A record's number is its slot's offset in the shard plus its rank in one of the
    slot's parts, so ranking needs no task larger than that, even if one record fills a slot.
    """
    spark = docs.sparkSession
    narrow = materialize(slotted(docs, id_col, text_col, n_slots), "slotted")
    stats = materialize(slot_stats(narrow), "slot-stats")
    slot_bytes = {r["vslot"]: r["b"] for r in stats.groupBy("vslot").agg(F.sum("bytes").alias("b")).collect()}
    path = map_path or f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    slots = next_version(spark, path, n_shards, n_slots, slot_bytes)
    here = spark.read.parquet(path).filter(F.col("version") == slots.version).select("vslot", "shard")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = stats.join(F.broadcast(here), "vslot").select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        narrow.withColumn("_rank", rank)
        .join(F.broadcast(places), ["vslot", "part"])  # n_slots * PARTS rows at most
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("_rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot",
            F.lit(slots.version).alias("map_version"),
        )
    )

"""Sharding by fixed virtual slots.

A record's slot is a hash of it, modulo a fixed number of thousands of slots. Bytes are added up
per slot, and a versioned map from slots to shards is built from these sums: the largest slot left
goes to the lightest shard. The map is a stored table. Later versions edit it: rebalance() moves single
slots from heavy to light shards, grow() gives a new shard slots of the others and moves none between
old shards. A record's shard is looked up by its slot, so that a new version moves whole slots and
hashes nothing.

The law of the query is `bytes`: sizes of the shards are near equal (to a slot's size).

The map has one row per slot, so it is of fixed size, whatever the number of records; it is edited on
the driver and broadcast. A record's place within its shard is the place in its slot plus that of the
slot in its shard; only records of one slot are sorted together.

Defined results: a null text has size 1 and the crc32 of no bytes. Equal records (same id, size and
crc32) are counted together and cut into chunks of CHUNK, and the slot is a hash of record and chunk, so
neither null ids nor a repeated row fill a slot; they get places of their own, in any order. A text of any
length counts whole and goes to one shard, so shards are as equal as that allows. Ties go to the smaller
number. Extra columns are left out, whatever their names. An empty table gives an empty table and a map
of empty slots.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 4096
CHUNK = 100
SHARDS = 16


@dataclass
class SlotMap:
    """Version, shard of each slot, and the bytes and records the slots had when it was made."""

    version: int
    shards: int
    shard_of: list[int]
    bytes_of: list[int] = field(default_factory=list)
    rows_of: list[int] = field(default_factory=list)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard_of, self.bytes_of, strict=True):
            out[s] += b
        return out

    @classmethod
    def build(cls, bytes_of: list[int], rows_of: list[int], shards: int, version: int = 1) -> SlotMap:
        """The largest slot left goes to the lightest shard; ties go to the smaller number."""
        heap, shard_of = [(0, s) for s in range(shards)], [0] * len(bytes_of)
        for slot in sorted(range(len(bytes_of)), key=lambda i: (-bytes_of[i], i)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + bytes_of[slot], shard))
        return cls(version, shards, shard_of, list(bytes_of), list(rows_of))

    def rebalance(self, bytes_of: list[int], rows_of: list[int], slack: float = 0.02) -> SlotMap:
        """A next version for new sums: slots move from the heaviest shard to the lightest while the
        heaviest is more than slack above the mean and a move makes the pair more equal."""
        new = SlotMap(self.version + 1, self.shards, list(self.shard_of), list(bytes_of), list(rows_of))
        loads, mean = new.loads(), sum(bytes_of) / self.shards
        for _ in range(len(bytes_of)):
            heavy, light = max(range(self.shards), key=loads.__getitem__), min(range(self.shards), key=loads.__getitem__)
            gap = loads[heavy] - loads[light]
            fits = [i for i, s in enumerate(new.shard_of) if s == heavy and 0 < bytes_of[i] < gap]
            if loads[heavy] <= (1 + slack) * mean or not fits:
                break
            slot = min(fits, key=lambda i: (abs(gap / 2 - bytes_of[i]), i))
            new.shard_of[slot] = light
            loads[heavy] -= bytes_of[slot]
            loads[light] += bytes_of[slot]
        return new

    def grow(self) -> SlotMap:
        """A next version with one more shard, which takes slots from the heaviest shards until it has
        its share; no slot moves between the others."""
        new = SlotMap(self.version + 1, self.shards + 1, list(self.shard_of), list(self.bytes_of), list(self.rows_of))
        loads, mean = new.loads(), sum(self.bytes_of) / new.shards
        for _ in range(len(self.bytes_of)):
            heavy = max(range(self.shards), key=loads.__getitem__)
            fits = [i for i, s in enumerate(new.shard_of) if s == heavy and 0 < self.bytes_of[i] <= mean - loads[self.shards]]
            if not fits:
                break
            slot = min(fits, key=lambda i: (abs(max(loads[heavy] - mean, 1) - self.bytes_of[i]), i))
            new.shard_of[slot] = self.shards
            loads[heavy] -= self.bytes_of[slot]
            loads[self.shards] += self.bytes_of[slot]
        return new

    def table(self, spark: SparkSession) -> DataFrame:
        """version, slot, shard, bytes, records, base: records of the slots before it in its shard."""
        base, rows = [0] * self.shards, []
        for slot, shard in enumerate(self.shard_of):
            rows.append((self.version, slot, shard, self.bytes_of[slot], self.rows_of[slot], base[shard]))
            base[shard] += self.rows_of[slot]
        return spark.createDataFrame(rows, "version int, slot int, shard int, bytes bigint, records bigint, base bigint")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the stored map, the newest if none is named."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("slot").collect()  # a row per slot: fixed size
        return cls(version, max(r["shard"] for r in rows) + 1, [r["shard"] for r in rows], [r["bytes"] for r in rows], [r["records"] for r in rows])


def records(df: DataFrame, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, chunk, n (rows of the chunk) and vslot: a row for each CHUNK
    of equal records or fewer."""
    plain = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(doc_id).alias("doc_id"), (F.length(plain) + 1).cast("bigint").alias("size"), F.crc32(plain).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("total"))
    rows = rows.select("doc_id", "size", "text_crc32", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / CHUNK).cast("bigint"))).alias("chunk"))
    rows = rows.withColumn("n", F.least(F.lit(CHUNK), F.col("total") - F.col("chunk") * CHUNK)).drop("total")
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", "chunk")
    return rows.withColumn("vslot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of each slot; these are slots rows at most, however many records there are."""
    bytes_of, rows_of = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("n")).collect():
        bytes_of[r["vslot"]], rows_of[r["vslot"]] = r["b"], r["n"]
    return bytes_of, rows_of


def slot_map(rows: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
    """A first map of records()."""
    return SlotMap.build(*slot_sums(rows, slots), shards)


def assign(rows: DataFrame, slots: SlotMap) -> DataFrame:
    """A row for each record of records(), with shard and slot: the record's place in its shard, gapless from 0.
    slots must be of these rows."""
    table = slots.table(rows.sparkSession).select(F.col("slot").alias("vslot"), "shard", "base")
    before = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(table), "vslot")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return rows.withColumn("slot", F.col("base") + F.col("inside") + F.col("i")).drop("base", "inside", "i", "n", "chunk")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards by the newest version of a stored map: made for 15, grown by one, and rebalanced."""
    rows = common.store(records(common.same_columns(common.documents(spark, sf_dir), ["doc_id", "text"])))
    sums = slot_sums(rows)
    path = f"{common.shared_dir(spark)}/skeinlog-slots-{uuid.uuid4().hex}"
    SlotMap.build(*sums, SHARDS - 1).save(spark, path)
    common.delete_at_end(spark, path)
    SlotMap.load(spark, path).grow().save(spark, path)
    SlotMap.load(spark, path).rebalance(*sums, slack=0.0).save(spark, path)
    out = assign(rows, SlotMap.load(spark, path))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")

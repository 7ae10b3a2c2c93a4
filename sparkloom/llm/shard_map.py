"""Sharding through fixed virtual slots.

A record's key is hashed into one of a few thousand slots for good. Bytes and rows are added up per slot, so what the
driver sees is bounded by the number of slots. A versioned map sends slots to shards; rebalancing edits the map, that
is moves a few slots, and never hashes records anew.

Defined results: a null text has 0 bytes (size 1) and the checksum 0. Repeated rows with the same id and text share a
slot and stand beside each other in it. An empty table gives an empty result, and a map in which no slot has bytes.
Columns of the input other than id and text are dropped by ``assign`` and kept by ``attach``.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm._lineage import shared_dir, spare

#: Virtual slots; fixed for the life of a corpus.
SLOTS = 4096
SHARDS = 16
#: How far the fullest shard may lie above the mean before a stored map is edited.
TOLERANCE = 1e-4


@dataclass
class SlotMap:
    """Which shard holds each slot. ``moved`` counts the slots that the last edit sent elsewhere."""

    shards: int
    owner: list[int]
    version: int = 1
    moved: int = 0
    history: list[tuple[int, list[int]]] = field(default_factory=list)

    @classmethod
    def spread(cls, slot_bytes: list[int], shards: int) -> "SlotMap":
        """A first map: slots by falling bytes, each to the shard with the fewest bytes so far."""
        load = [(0, s) for s in range(shards)]
        owner = [0] * len(slot_bytes)
        for slot in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
            total, shard = heapq.heappop(load)
            owner[slot] = shard
            heapq.heappush(load, (total + slot_bytes[slot], shard))
        return cls(shards, owner)

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += slot_bytes[slot]
        return out

    def rebalanced(self, slot_bytes: list[int], shards: int | None = None, tolerance: float = 0.0) -> "SlotMap":
        """The next version: slots move from the fullest to the emptiest shard while that brings the two nearer.

        ``shards`` may grow or shrink; slots of shards that no longer exist move first. Moves stop once the fullest
        shard is within ``tolerance`` of the mean. The older versions stay in ``history``.
        """
        shards = shards or self.shards
        owner = list(self.owner)
        held: list[list[int]] = [[] for _ in range(shards)]
        load = [0] * shards
        homeless = []
        for slot, shard in enumerate(owner):
            if shard < shards:
                held[shard].append(slot)
                load[shard] += slot_bytes[slot]
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda k: (-slot_bytes[k], k)):
            to = min(range(shards), key=lambda s: (load[s], s))
            owner[slot] = to
            held[to].append(slot)
            load[to] += slot_bytes[slot]
        mean = sum(load) / shards
        for _ in range(4 * len(owner)):
            top = max(range(shards), key=lambda s: (load[s], -s))
            low = min(range(shards), key=lambda s: (load[s], s))
            gap = load[top] - load[low]
            if load[top] <= mean * (1 + tolerance):
                break
            fit = [k for k in held[top] if 0 < slot_bytes[k] < gap]
            if not fit:
                break
            slot = min(fit, key=lambda k: (abs(gap / 2 - slot_bytes[k]), k))
            owner[slot] = low
            held[top].remove(slot)
            held[low].append(slot)
            load[top] -= slot_bytes[slot]
            load[low] += slot_bytes[slot]
        moved = sum(a != b for a, b in zip(self.owner, owner, strict=True))
        return SlotMap(shards, owner, self.version + 1, moved, [*self.history, (self.version, list(self.owner))])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.owner)]
        return spark.createDataFrame(rows, "vslot int, shard int, shards int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of versions at ``path``; writing a version again replaces it."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> "SlotMap":
        """A stored version, the newest by default, with the older ones as its history."""
        versions: dict[int, list[tuple[int, int, int]]] = {}
        for v, slot, shard, shards in spark.read.parquet(path).select("version", "vslot", "shard", "shards").collect():
            versions.setdefault(int(v), []).append((slot, shard, shards))
        owners = {v: [shard for _, shard, _ in sorted(rows)] for v, rows in versions.items()}
        version = max(owners) if version is None else version
        if version not in owners:
            raise ValueError(f"no version {version} at {path}")
        before = [(v, owners[v]) for v in sorted(owners) if v < version]
        moved = sum(a != b for a, b in zip(before[-1][1], owners[version], strict=True)) if before else 0
        return cls(versions[version][0][2], owners[version], version, moved, before)

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> "SlotMap | None":
        """The newest version at a path, or None where nothing is stored."""
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return cls.load(spark, path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None

    @classmethod
    def kept(cls, spark: SparkSession, path: str, slot_bytes: list[int], shards: int, tolerance: float = TOLERANCE) -> "SlotMap":
        """The map stored at ``path``, edited for ``shards`` and the present bytes where they ask for it; a first one where there is none.

        The first map is stored as version 1, each edit as the next version. A map in balance within ``tolerance`` stays as it is.
        """
        now = cls.stored(spark, path)
        if now is None:
            now = cls.spread(slot_bytes, shards)
            now.save(spark, path)
        if len(now.owner) != len(slot_bytes):
            raise ValueError(f"the map at {path} has {len(now.owner)} slots, not {len(slot_bytes)}")
        loads = now.loads(slot_bytes)
        if now.shards != shards or max(loads) > (1 + tolerance) * sum(loads) / len(loads):
            edited = now.rebalanced(slot_bytes, shards)
            if edited.moved or edited.shards != now.shards:
                now = edited
                now.save(spark, path)
        return now


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(key: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot; at most ``slots`` rows reach the driver."""
    size, rows = [0] * slots, [0] * slots
    for slot, b, n in records.groupBy("__vslot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[slot], rows[slot] = int(b), int(n)
    return size, rows


def records(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    size, crc = text_size(F.col(text_col)), text_crc(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32")).withColumn("__vslot", slot_of([F.col("doc_id"), F.col("text_crc32")], slots))


def default_path(spark: SparkSession, slot_bytes: list[int], shards: int) -> str:
    """Where the map of a corpus of these loads is stored: runs over one corpus share a map, and leave no more than that."""
    name = zlib.crc32(repr((shards, slot_bytes)).encode())
    return f"{shared_dir(spark).rstrip('/')}/slot-map-{len(slot_bytes)}-{sum(slot_bytes)}-{name:08x}"


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, slot_map: SlotMap | None = None, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Shard and place of each record: ``doc_id, size, text_crc32, vslot, shard, slot, map_version``.

    ``slot`` counts from 0 without gaps in each shard, by virtual slot, then id. Only the id, the size and the checksum
    of a record are shuffled, on the virtual slot, so no task holds a whole shard. The map is the one stored at ``map_path``
    (default: a folder of this corpus in the shared one), made or edited as ``SlotMap.kept`` says. A given ``slot_map`` is used as
    it is, or edited if it has another number of shards, and stored only under a given path.
    """
    spark = docs.sparkSession
    rec = records(docs, id_col, text_col, slots)
    slot_bytes, slot_rows = slot_loads(rec, slots)
    if slot_map is None:
        slot_map = SlotMap.kept(spark, map_path or default_path(spark, slot_bytes, shards), slot_bytes, shards)
    else:
        if slot_map.shards != shards:
            slot_map = slot_map.rebalanced(slot_bytes, shards)
        if map_path:
            slot_map.save(spark, map_path)
    base, filled = [0] * slots, [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.owner):
        base[slot] = filled[shard]
        filled[shard] += slot_rows[slot]
    # The map has exactly `slots` rows, a constant, so it may be broadcast.
    lookup = spark.createDataFrame([(k, slot_map.owner[k], base[k]) for k in range(slots)], "__vslot int, shard int, __base long")
    place = Window.partitionBy("__vslot").orderBy("doc_id", "text_crc32", "size")
    out = rec.withColumn("__rank", F.row_number().over(place)).join(F.broadcast(lookup), "__vslot")
    return out.select("doc_id", "size", "text_crc32", F.col("__vslot").alias("vslot"), "shard", (F.col("__base") + F.col("__rank") - 1).cast("long").alias("slot"), F.lit(slot_map.version).alias("map_version")), slot_map


def attach(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """The documents with a column ``shard`` (replacing one of that name) and no shuffle: records stay where they are."""
    spark = docs.sparkSession
    slot_bytes, _ = slot_loads(records(docs, id_col, text_col, slots), slots)
    slot_map = SlotMap.kept(spark, map_path or default_path(spark, slot_bytes, shards), slot_bytes, shards)
    at, to = spare(docs, "__vslot"), spare(docs, "__shard")
    lookup = spark.createDataFrame(list(enumerate(slot_map.owner)), f"{at} int, {to} int")
    keyed = docs.withColumn(at, slot_of([F.col(id_col), text_crc(F.col(text_col))], slots))
    return keyed.join(F.broadcast(lookup), at).withColumn("shard", F.col(to)).drop(at, to)


def op2_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes (law ``bytes``)."""
    out, _ = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")

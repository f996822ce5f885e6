"""Sharding by fixed virtual slots.

A record's key is hashed into one of some thousands of slots once and for all. A versioned slot-to-shard map, stored as a
small table, says where each slot lives; a rebalance edits rows of the map, never the hash. The table has a folder per
version with the slots that the version moves; the first has them all. Two edits are offered: `add_shard` appends a version in
which a new shard takes slots only into itself, by slot numbers alone, and `rebalance_map` one that moves slots off overfull
shards by the bytes summed per slot.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_exists, folders_in, hex_int, key_hex, materialise

SLOTS = 4096
#: Lots that rows of one key and content are dealt into.
LOTS = 64
#: Bytes that a record has besides its text.
ROW_BYTES = 16


def slot_of(key: Column, slots: int = SLOTS, seed: str = "slots") -> Column:
    return F.pmod(hex_int(F.substring(key_hex(seed, key), 1, 12)), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[list[int]]:
    """Version `shards` of the map, reached from one shard by growing one at a time. Each row is [version, slot, shard]."""
    owner = [0] * slots
    for n in range(1, shards):
        for slot in grow(owner, n):
            owner[slot] = n
    return [[shards, s, o] for s, o in enumerate(owner)]


def grow(owner: list[int], shards: int) -> list[int]:
    """Slots that shard number `shards` takes when it joins: its fair share, always from the shard with the most slots,
    ties to the smaller number, and there the last slot. Depends on slot and shard numbers alone."""
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, o in enumerate(owner):
        held[o].append(slot)
    heap = [(-len(h), o) for o, h in enumerate(held)]
    heapq.heapify(heap)
    taken = []
    for _ in range(len(owner) // (shards + 1)):
        n, o = heapq.heappop(heap)
        taken.append(held[o].pop())
        heapq.heappush(heap, (n + 1, o))
    return taken


def rebalance(owner: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.05) -> list[list[int]]:
    """Edits [slot, from, to] that bring each shard within the tolerance of the mean bytes where single slots allow it:
    while the fullest shard is over, its largest slot that still fits moves to the emptiest."""
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, o in enumerate(owner):
        load[o] += slot_bytes.get(slot, 0)
        held[o].add(slot)
    most, edits = sum(load) / shards * (1 + tolerance), []
    for _ in range(len(owner)):
        a, b = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        fits = [s for s in held[a] if 0 < slot_bytes.get(s, 0) < load[a] - load[b]]
        if load[a] <= most or not fits:
            break
        s = max(fits, key=lambda x: (slot_bytes[x], -x))
        held[a].remove(s)
        held[b].add(s)
        load[a] -= slot_bytes[s]
        load[b] += slot_bytes[s]
        edits.append([s, a, b])
    return edits


MAP_SCHEMA = "vslot int, owner int, shards int"


def _versions(spark: SparkSession, path: str) -> list[int]:
    # a version counts once its job has committed, so that a run that died half-way leaves none behind
    return sorted(int(name.split("=")[1]) for name in folders_in(spark, path) if name.startswith("version=") and file_exists(spark, f"{path}/{name}/_SUCCESS"))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int, list[int]] | None:
    """(version, number of shards, owner of each slot) of the last version or of that given; None where no map is stored. The map
    has as many rows as there are slots, and as many more as were ever moved."""
    known = [v for v in _versions(spark, path) if version is None or v <= version]
    if not known:
        return None
    rows = []
    for v in known:
        rows += [(v, *r) for r in spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={v}").collect()]
    owner: dict[int, int] = {}
    shards = 0
    for _, slot, o, n in sorted(rows):
        owner[slot], shards = o, n
    return known[-1], shards, [owner[s] for s in range(len(owner))]


def append_version(spark: SparkSession, path: str, edits: list[tuple[int, int]], shards: int) -> int:
    """Stores (slot, owner) edits as the next version and returns its number. A version without edits is not stored."""
    last = max(_versions(spark, path), default=0)
    if not edits:
        return last
    rows = [(int(s), int(o), shards) for s, o in edits]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={last + 1}")
    return last + 1


def ensure_map(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> tuple[int, int, list[int]]:
    """The stored map; where there is none yet, the first version for so many shards is stored."""
    now = load_map(spark, path)
    if now is None:
        append_version(spark, path, [(s, o) for _, s, o in first_map(shards, slots)], shards)
        now = load_map(spark, path)
    return now


def add_shard(spark: SparkSession, path: str) -> int:
    """Appends the version in which one more shard joins."""
    _, shards, owner = load_map(spark, path)
    return append_version(spark, path, [(s, shards) for s in grow(owner, shards)], shards + 1)


def rebalance_map(spark: SparkSession, path: str, docs: DataFrame, tolerance: float = 0.05) -> int:
    """Appends the version in which slots have moved off shards whose bytes are over the mean by more than the tolerance. The
    driver sees one row of sums per slot."""
    _, shards, owner = load_map(spark, path)
    sums = {r.vslot: r.bytes for r in slot_bytes(place(docs, len(owner))).collect()}
    return append_version(spark, path, [(s, b) for s, _, b in rebalance(owner, sums, shards, tolerance)], shards)


def slot_bytes(placed: DataFrame) -> DataFrame:
    """Rows and bytes per slot (from place()): at most as many rows as there are slots."""
    return placed.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def place(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each row."""
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("vslot", slot_of(F.col("doc_id"), slots))


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Each row's virtual slot, shard and place in the shard, and its shard when one more shard joins.

    path is the folder of a stored map, whose last version is used; without one, a map for so many shards and slots is made.
    Columns: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law ("key"), shard, slot (place in the shard in
    order of virtual slot, doc_id, crc and size: gapless from 0), grown_shard, vslot (the virtual slot). The law holds for
    maps that `add_shard` alone has edited.
    A null text counts as empty, a null doc_id hashes as a key of its own, rows that agree in doc_id, crc and size share a
    virtual slot and take one place each, whichever of them takes which; an empty table gives no rows; very long texts are
    read in one pass; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    if path is None:
        shards, owner = shards, [o for _, _, o in first_map(shards, slots)]
    else:
        _, shards, owner = ensure_map(spark, path, shards, slots)
    taken = set(grow(owner, shards))
    owners = spark.createDataFrame([(s, o, shards if s in taken else o) for s, o in enumerate(owner)], "vslot int, shard int, grown_shard int")
    # equal rows are dealt into lots by where they were written, so that a key with a third of all rows is no single window
    lot = F.pmod(F.monotonically_increasing_id(), F.lit(LOTS)).cast("int")
    placed = materialise(place(docs, len(owner)).select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_crc32", "size", "vslot", lot.alias("lot")), "placed")
    same = ["vslot", "no_id", "id", "text_crc32", "size", "lot"]
    counts = placed.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("vslot").orderBy(F.col("no_id").desc(), "id", "text_crc32", "size", "lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n")
    per_slot = owners.join(slot_bytes(placed), "vslot", "left")
    base = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = per_slot.select("vslot", "shard", "grown_shard", F.coalesce(F.sum("rows").over(base), F.lit(0)).cast("long").alias("base"))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))).cast("long") - 1)
    out = ranked.join(lots, same).join(F.broadcast(per_slot), "vslot")
    doc_id = F.when(~F.col("no_id"), F.col("id"))
    return out.select(doc_id.alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("before") + F.col("at")).alias("slot"), "grown_shard", "vslot")

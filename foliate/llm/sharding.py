"""Sharding by fixed virtual slots.

A record's id is hashed into one of ``SLOTS`` virtual slots for good. A table of versions says which
shard holds which slot; adding a shard or rebalancing appends a version in which some slots have
moved. Only those slots' records move then.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

SLOTS = 4096
SHARDS = 40
#: Bytes of a record beside its text.
RECORD_BYTES = 16
MAP = "version int, n_shards int, vslot int, shard int"


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Depends on the key alone; a null key counts as an empty one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def _rank(slot: int, shard: int) -> str:
    return hashlib.md5(f"{slot}/{shard}".encode()).hexdigest()


def grown(shards: list[int], n: int) -> list[int]:
    """The slots' shards once shard ``n`` joins the ``n`` there are: it takes its share of slots, from the fullest shards."""
    now, counts = list(shards), [0] * (n + 1)
    held: dict[int, list[int]] = {s: [] for s in range(n)}
    for slot, shard in enumerate(shards):
        counts[shard] += 1
        held[shard].append(slot)
    for slots in held.values():
        slots.sort(key=lambda slot: _rank(slot, n), reverse=True)
    for _ in range(len(shards) // (n + 1)):
        fullest = max(range(n), key=lambda s: (counts[s], -s))
        now[held[fullest].pop()] = n
        counts[fullest] -= 1
    return now


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The first map of so many shards; the number of shards decides it."""
    now = [0] * slots
    for n in range(1, shards):
        now = grown(now, n)
    return now


def rebalanced(shards: list[int], sizes: list[int], n: int, tolerance: float = 0.01) -> list[int]:
    """Slots moved one by one from the heaviest shard to the lightest while that evens them out.

    ``sizes``: bytes of each slot. It ends when no shard is further than ``tolerance`` from the mean,
    or no single move helps.
    """
    now, load = list(shards), [0] * n
    for slot, shard in enumerate(shards):
        load[shard] += sizes[slot]
    mean = sum(load) / n
    for _ in range(4 * len(shards)):
        high, low = max(range(n), key=lambda s: (load[s], -s)), min(range(n), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if max(load[high] - mean, mean - load[low]) <= tolerance * mean:
            break
        fitting = [s for s, shard in enumerate(now) if shard == high and 0 < sizes[s] < gap]
        if not fitting:
            break
        best = min(fitting, key=lambda s: (abs(2 * sizes[s] - gap), s))
        now[best] = low
        load[high] -= sizes[best]
        load[low] += sizes[best]
    return now


def load_maps(spark: SparkSession, path: str) -> DataFrame:
    """All versions stored at ``path``."""
    return spark.read.schema(MAP).parquet(path)


def append_versions(spark: SparkSession, path: str, maps: list[tuple[int, list[int]]]) -> list[int]:
    """Stores maps ``(shards, a shard for each slot)`` after those at ``path``, which stay as they are; their version numbers."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stored = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    last = (load_maps(spark, path).agg(F.max("version")).first()[0] or 0) if stored else 0
    rows = [(last + v, n, slot, shard) for v, (n, shards) in enumerate(maps, 1) for slot, shard in enumerate(shards)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)
    return [last + v for v in range(1, len(maps) + 1)]


def version_of(maps: DataFrame, version: int) -> list[int]:
    """A version as a list, a shard for each slot: it has as many entries as there are slots, whatever the input."""
    return [r["shard"] for r in maps.where(F.col("version") == version).orderBy("vslot").collect()]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, vslot, size, text_crc32)``: all that placing a record takes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES
    return docs.select("doc_id", virtual_slot(F.col("doc_id"), slots).alias("vslot"), size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """``(vslot, n, bytes)``; one row for each slot in use."""
    return rows.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def place(rows: DataFrame, maps: DataFrame, version: int = 1) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the record's number within its shard, gapless from 0.

    Records are numbered within their virtual slot, and the slots one after the other: no task has to
    order a whole shard. The tables joined have a row for each virtual slot, whatever the input.
    """
    spread = slot_loads(rows).join(F.broadcast(maps.where(F.col("version") == version).select("vslot", "shard")), "vslot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    spread = spread.select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("first"), F.col("bytes").alias("vslot_bytes"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("within", within).join(F.broadcast(spread), "vslot").withColumn("slot", (F.col("first") + F.col("within") - 1).cast("long")).drop("first", "within")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, vslot_bytes, rebalanced_shard)`` for each input row.

    The law is ``key``: doc_id and the number of shards decide. ``grown_shard`` is the shard once
    there is one more; it differs only where that is the new one. ``rebalanced_shard`` is the shard
    after slots have moved so that the shards' bytes are even, which the law doesn't do. A null text
    has no bytes and crc32 0, a null doc_id counts as an empty key; repeated rows get slots of their
    own, ties are settled by size and crc32. The three maps are versions of one table, stored at ``path`` (a new one) if given.
    """
    spark = docs.sparkSession
    first = slot_map(shards, slots)
    path = path or scratch_path(spark, "slot-map")
    rows = materialize(records(docs, slots), "records")
    loads = {r["vslot"]: r["bytes"] for r in slot_loads(rows).collect()}  # a row for each slot
    even = rebalanced(first, [loads.get(s, 0) for s in range(slots)], shards)
    one, grows, evens = append_versions(spark, path, [(shards, first), (shards + 1, grown(first, shards)), (shards, even)])
    maps = load_maps(spark, path)
    of = lambda version, name: F.broadcast(maps.where(F.col("version") == version).select("vslot", F.col("shard").alias(name)))
    out = place(rows, maps, one).join(of(grows, "grown_shard"), "vslot").join(of(evens, "rebalanced_shard"), "vslot").withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "vslot_bytes", "rebalanced_shard")

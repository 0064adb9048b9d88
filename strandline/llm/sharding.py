"""Sharding by fixed virtual slots.

A record's hash puts it into one of `slots` virtual slots, for good. Bytes are aggregated by slot, and a
versioned table maps slots to shards: version 1 deals the slots out in turn, and each rebalancing edits the
last version, moving whole slots from heavy to light shards. A slot far above the mean, as one record repeated often
makes it, is kept as several parts, which its records join in turn; each part is a slot of the map. Only
slots x shards numbers (thousands) are ever handled in one place. DataFrame operations only on the records.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import scratch

SLOTS = 4096
OVERHEAD = 16
HEAVY = 4
MAP = "version int, slot int, shard int, base int, part int"


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def virtual_slot(slots: int = SLOTS) -> Column:
    """From the id and the text's checksum, so that repeated ids of different texts spread; nulls hash like nothing."""
    return F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, largest record), at most `slots` rows."""
    sized = docs.select(virtual_slot(slots).alias("vslot"), record_size().alias("size"))
    return sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def dealt(slots: int, shards: int) -> list[int]:
    """Version 1 of a map: slot -> shard, in turn."""
    return [k % shards for k in range(slots)]


def rebalanced(shard_of: list[int], sizes: list[int], shards: int, max_moves: int = 100_000) -> list[int]:
    """The map edited: slots move from the heaviest to the lightest shard as long as that narrows the two.

    The slot moved is the one nearest to half their difference, so every move lowers the sum of squares and
    the edit ends; slots without bytes stay. Ties go to the lower shard and slot.
    """
    out = list(shard_of)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += sizes[slot]
        if sizes[slot]:
            held[shard].append((sizes[slot], slot))
    heavy, light = [(-load[s], s) for s in range(shards)], [(load[s], s) for s in range(shards)]
    heapq.heapify(heavy)
    heapq.heapify(light)
    for _ in range(max_moves):
        while -heavy[0][0] != load[heavy[0][1]]:
            heapq.heappop(heavy)
        while light[0][0] != load[light[0][1]]:
            heapq.heappop(light)
        h, low = heavy[0][1], light[0][1]
        gap = load[h] - load[low]
        fits = [x for x in held[h] if x[0] < gap]
        if not fits:
            break
        size, slot = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[h].remove((size, slot))
        held[low].append((size, slot))
        out[slot] = low
        load[h] -= size
        load[low] += size
        for s in (h, low):
            heapq.heappush(heavy, (-load[s], s))
            heapq.heappush(light, (load[s], s))
    return out


def layout(sizes: list[int], largest: list[int], shards: int) -> list[tuple[int, int, int]]:
    """(base, part, bytes) of each slot of the map: a base slot's first part has its number, the others follow all base slots.

    A slot of more than HEAVY times the mean, and more than a 32nd of a shard, has as many parts as bring it there,
    but none for less than two of its largest record.
    """
    total = sum(sizes)
    most = max(1, HEAVY * total // len(sizes), total // (32 * shards))
    parts = [max(1, min(-(-x // most), x // max(1, 2 * y))) for x, y in zip(sizes, largest, strict=True)]
    rest = [(k, j, sizes[k] // n) for k, n in enumerate(parts) for j in range(1, n)]
    return [(k, 0, sizes[k] // n) for k, n in enumerate(parts)] + rest


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int], slots: list[tuple[int, int, int]] | None = None) -> None:
    """Add a version to the map table at path; slots: from layout(), all of one part by default."""
    of = [x[:2] for x in slots] if slots else [(k, 0) for k in range(len(shard_of))]
    rows = spark.createDataFrame([(version, k, s, *of[k]) for k, s in enumerate(shard_of)], MAP)
    rows.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard, base, part) of a version of the table, the newest by default: 1 + 1 / HEAVY times as many rows as slots at most."""
    table = spark.read.schema(MAP).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return table.where(F.col("version") == version).select("slot", "shard", "base", "part")


def plan(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> tuple[str, list[int], int]:
    """Store version 1 and its rebalanced edit for docs; the table's path, the edited map, all bytes."""
    spark = docs.sparkSession
    path, sizes, largest = path or scratch(spark, "slot-map"), [0] * slots, [0] * slots
    for r in slot_bytes(docs, slots).collect():  # at most `slots` rows
        sizes[r["vslot"]], largest[r["vslot"]] = r["bytes"], r["largest"]
    parts = layout(sizes, largest, shards)
    first = dealt(len(parts), shards)
    edited = rebalanced(first, [n for _, _, n in parts], shards)
    store_map(spark, path, 1, first, parts)
    store_map(spark, path, 2, edited, parts)
    return path, edited, sum(sizes)


def write_shards(docs: DataFrame, shards: int, out: str, slots: int = SLOTS, map_path: str | None = None, bytes_per_file: int = 128 << 20) -> tuple[str, list[int]]:
    """Write docs (all their columns, and vslot) under out/shard=K, each shard's size near the mean; the map's path, and the map.

    A shard is written by as many tasks as its bytes need, to each of which its records go in turn. Columns vslot and
    shard of docs are replaced.
    """
    map_path, edited, total = plan(docs, shards, slots, map_path)
    files = max(1, total // shards // bytes_per_file + 1)
    by = load_map(docs.sparkSession, map_path).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("part", "slot", "shard"))).alias("__to"))
    rows = docs.drop("vslot", "shard").withColumn("__base", virtual_slot(slots)).join(F.broadcast(by), F.col("__base") == F.col("base")).drop("__base", "base")
    rows = rows.withColumn("__turn", F.monotonically_increasing_id())
    to = F.get("__to", F.pmod("__turn", F.size("__to")).cast("int"))
    rows = rows.withColumn("__at", to).withColumn("vslot", F.col("__at.slot")).withColumn("shard", F.col("__at.shard"))
    file = F.pmod(F.xxhash64("__turn"), F.lit(files)).cast("int") if files > 1 else F.lit(0)
    dealt_rows = rows.repartitionById(shards * files, F.col("shard") * files + file)
    dealt_rows.drop("__to", "__turn", "__at").write.mode("overwrite").partitionBy("shard").parquet(out)
    return map_path, edited


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, out: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot), read back from the shards written.

    Law `bytes`: the shards' sizes are near equal, as far as whole records and slots allow. Equal texts are a group of
    copies; as such a group may hold any share of the bytes, it is not kept in one shard: its records go by their ids,
    and records alike in both by turn. slot is a record's gapless place in its shard: by virtual slot, then doc_id and
    checksum, nulls first. A null text has no bytes and the checksum of an empty one; rows with a null id or repeated rows
    are kept, each with a place of its own. Other columns of docs are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    out = out or scratch(spark, "shards")
    _, edited = write_shards(docs.select("doc_id", "text"), shards, out, slots)
    kind = docs.schema["doc_id"].dataType.simpleString()
    back = spark.read.schema(f"doc_id {kind}, text string, vslot int, shard int").parquet(out)
    rows = {r["vslot"]: r["count"] for r in back.groupBy("vslot").count().collect()}  # at most as many as the map
    before, offset = [0] * shards, []
    for k, shard in enumerate(edited):
        offset.append((k, before[shard]))
        before[shard] += rows.get(k, 0)
    offsets = F.broadcast(spark.createDataFrame(offset, "vslot int, before long"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = back.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), "shard", "vslot")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size"))
    ranked = narrow.withColumn("place", place).join(offsets, "vslot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")

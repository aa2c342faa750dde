"""Sharding by fixed virtual slots.

Rows hash into thousands of slots whose number never changes; only the small table
slot -> shard decides where a slot lives. Rebalancing edits that table: slots stay where they are
while their shard is within its share of the bytes, the others move to the lightest shard.
Everything is DataFrame expressions; what grows with the data is one aggregation by slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SLOTS = 4096
ROW_OVERHEAD = 8


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """Slot of a row. A NULL key takes no part in the hash, so give more than one key."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """``(vslot, bytes, n)`` from rows with ``vslot`` and ``size``: at most one row per slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """First version of a map: slots dealt out in turn, without knowledge of the data."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def edit_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for ``shards`` shards of near equal bytes.

    Of a shard above its share, slots are let loose in the order of their numbers, each that fits what is left of the excess; so few bytes
    move and the shard ends just above its share. All slots of shards that no longer exist are loose. Loose slots go, largest first, each to the
    shard that is lightest so far. Slots without rows stay where they are if they can; ties go by slot and shard number. Without rows nothing moves
    but slots of shards that are gone. The folds run over at most one entry per slot.
    """
    known = current.join(sizes, "vslot", "left").select(
        "vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = known.agg((F.sum("bytes") / shards).alias("share"))
    held = known.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("vslot", "bytes"))).alias("slots"), F.sum("bytes").alias("all"))
    fits = F.aggregate(
        "slots", F.struct((F.col("all") - F.col("share")).alias("left"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.when((x["bytes"] > 0) & (x["bytes"] <= acc["left"]), F.struct((acc["left"] - x["bytes"]).alias("left"), F.concat(acc["out"], F.array(x["vslot"])).alias("out"))).otherwise(acc))
    loosened = held.crossJoin(F.broadcast(total)).select("shard", "slots", fits["out"].alias("out"))  # total is one row
    judged = loosened.select("shard", "out", F.inline("slots")).withColumn("keeps", (F.col("shard") < shards) & ~F.array_contains("out", F.col("vslot")))
    state = judged.agg(
        F.map_from_entries(F.collect_list(F.when(F.col("keeps"), F.struct("vslot", "shard")))).alias("kept"),
        F.collect_list(F.when(F.col("keeps"), F.struct(F.col("shard"), F.col("bytes")))).alias("loads"),
        F.sort_array(F.collect_list(F.when(~F.col("keeps"), F.struct((-F.col("bytes")).alias("minus"), F.col("vslot"))))).alias("loose"))
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    loads = F.aggregate("loads", zero, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["shard"], v + x["bytes"]).otherwise(v)))
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(acc, slot):
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda v, i: F.when(i == lightest, v - slot["minus"]).otherwise(v))
        return F.struct(grown.alias("loads"), F.concat(acc["to"], F.array(lightest)).alias("to"))

    placed = state.select("kept", F.transform("loose", lambda x: x["vslot"]).alias("loose"), F.aggregate("loose", start, place)["to"].alias("to"))
    moved = F.transform(F.arrays_zip("loose", "to"), lambda x: F.struct(x["loose"].alias("vslot"), x["to"].alias("shard")))
    kept = F.transform(F.map_entries("kept"), lambda x: F.struct(x["key"].alias("vslot"), x["value"].alias("shard")))
    return placed.select(F.explode(F.concat(kept, moved)).alias("x")).select("x.vslot", "x.shard")


def store_map(mapping: DataFrame, folder: str, version: int) -> None:
    """Write one version of the map; earlier versions stay readable."""
    mapping.coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the latest, as ``(vslot, shard)``."""
    found = spark.read.parquet(folder)
    wanted = found.agg(F.max("version")).first()[0] if version is None else version
    return spark.read.parquet(f"{folder}/version={wanted}")


def balanced(sizes: DataFrame, shards: int, folder: str) -> DataFrame:
    """Second version of a map for slots of the given sizes: an even first one, edited; both are stored in ``folder``."""
    spark = sizes.sparkSession
    store_map(even_map(spark, shards), folder, 1)
    store_map(edit_map(load_map(spark, folder), sizes, shards), folder, 2)
    return load_map(spark, folder, 2)


def assign(rows: DataFrame, mapping: DataFrame, sizes: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their ``shard`` and ``slot``, the gapless place of a row in its shard.

    The place is the row's rank within its virtual slot plus the number of rows in the shard's earlier slots; so the
    ranking runs over thousands of small groups, never over a shard. The map has one row per slot, a fixed bound.
    ``shard`` and ``slot`` replace columns of ``rows`` of these names. Ties in ``order`` are broken arbitrarily, so give what tells rows apart; repeated
    rows share a virtual slot and get places of their own. Text does not matter here, only ``vslot``; an empty table has no rows.
    """
    by_shard = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    first = mapping.join(sizes, "vslot").select(F.col("vslot").alias("__vslot"), "shard", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("__first"))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    rank = F.row_number().over(W.partitionBy("vslot").orderBy(*order)) - 1
    placed = rows.withColumn("__rank", rank).select(*kept, "__rank").join(F.broadcast(first), F.col("vslot") == F.col("__vslot"))
    return placed.select(*kept, "shard", (F.col("__first") + F.col("__rank")).cast("long").alias("slot"))

"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots. Bytes are summed per slot, a versioned table says which shard
holds which slot. It is stored (``store_map``), loaded again (``load_map``) and edited: growing moves slots into the new shard and
nowhere else, rebalancing moves them from shards over the mean to those below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Slots, whatever the corpus size; the slot table is collected, broadcast and edited, so this is its size bound.
N_SLOTS = 8192
ROW_OVERHEAD = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a key; all null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_totals(records: DataFrame, n_slots: int = N_SLOTS, rows: Column | None = None) -> DataFrame:
    """Bytes and rows of every slot, empty ones too: ``records`` has virtual_slot and size, and is counted or summed by ``rows``."""
    seen = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), (F.count(F.lit(1)) if rows is None else rows).alias("rows"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(seen, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(totals: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the slot map: largest slots first, each to the shard with the fewest bytes so far.

    One array of the fixed slot count is folded, so the work does not depend on the corpus.
    """
    ordered = totals.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("virtual_slot").alias("s")))).alias("slots")
    )
    dealt = ordered.select(
        F.expr(
            f"""aggregate(slots,
                  named_struct('loads', array_repeat(0L, {n_shards}), 'pick', 0,
                               'dealt', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
                  (a, x) -> transform(array(transform(a.loads, (v, i) -> if(i = a.pick, v - x.neg, v))), l ->
                    named_struct('loads', l, 'pick', cast(array_position(l, array_min(l)) - 1 as int),
                                 'dealt', concat(a.dealt, array(named_struct('virtual_slot', x.s, 'shard', a.pick)))))[0],
                  a -> a.dealt)"""
        ).alias("dealt")
    )
    return dealt.select(F.inline("dealt")).withColumn("version", F.lit(1))


def grow(slot_map: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """The next version, for one more shard than ``n_shards``: shards above the new mean give slots to it, none else move."""
    held = slot_map.join(F.broadcast(totals.select("virtual_slot", "bytes")), "virtual_slot")
    shard = Window.partitionBy("shard")
    order = shard.orderBy(F.xxhash64("virtual_slot"), "virtual_slot")
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(n_shards + 1)
    given = F.sum("bytes").over(order) <= F.sum("bytes").over(shard) - mean
    return held.select("virtual_slot", F.when(given, F.lit(n_shards)).otherwise(F.col("shard")).alias("shard"), (F.col("version") + 1).alias("version"))


def rebalance(slot_map: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """The next version for changed loads: shards over the mean give slots until they aren't, shards below the mean take them.

    Slots given lie end to end by bytes, and so does what the takers lack; a slot goes to the shard in whose stretch its middle
    lies. Slots of shards that are neither over nor below stay, as do the first slots of each giver up to the mean.
    """
    held = slot_map.join(F.broadcast(totals.select("virtual_slot", "bytes")), "virtual_slot")
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot")
    mean = F.sum("bytes").over(everything) / F.lit(n_shards)
    marked = held.withColumn("mean", mean).withColumn("given", F.sum("bytes").over(order) > F.col("mean"))
    given = marked.filter("given").withColumn("middle", F.sum("bytes").over(everything.orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") / 2)
    keeps = marked.filter("not given").groupBy("shard").agg(F.sum("bytes").alias("kept"))
    shards = held.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("to"))
    lacks = shards.crossJoin(F.broadcast(held.agg((F.sum("bytes") / n_shards).alias("mean")))).join(F.broadcast(keeps), F.col("to") == F.col("shard"), "left")
    lacks = lacks.select("to", F.greatest(F.col("mean") - F.coalesce("kept", F.lit(0)), F.lit(0.0)).alias("lack"))
    ends = lacks.withColumn("end", F.sum("lack").over(everything.orderBy("to").rowsBetween(Window.unboundedPreceding, 0))).filter("lack > 0")
    # slots and shards are few, whatever the corpus
    moved = given.join(F.broadcast(ends), (F.col("middle") <= F.col("end")) & (F.col("middle") > F.col("end") - F.col("lack")), "left")
    moved = moved.select("virtual_slot", F.coalesce("to", "shard").cast("int").alias("shard"), "version")
    return marked.filter("not given").select("virtual_slot", "shard", "version").unionByName(moved).withColumn("version", F.col("version") + 1)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions that are there stay as they are."""
    slot_map.select("virtual_slot", "shard", "version").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a stored map, or the one asked for."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    newest = every.agg(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == newest)


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, scratch: Scratch | None = None, slot_map: DataFrame | None = None, map_path: str | None = None) -> DataFrame:
    """Every row's size, virtual slot, shard, and place in its shard.

    The law is ``bytes``: shards get nearly equal bytes. ``slot`` counts from 0 without gaps within a shard: each virtual slot
    starts where the one before it ends, and within it each part of the input where the part before ends. Rows go to virtual slots
    by doc_id and text, so rows without an id spread by their texts; repeats of a row within a part of the input spread by
    their number too, so that a row repeated very often doesn't fill one shard. Null and empty texts have the overhead alone as size and checksum 0; an empty table gives no rows.
    Only doc_id and text are read, so other columns may have any name.

    ``slot_map`` (virtual_slot, shard, version; as ``load_map`` gives it) places the rows by a stored map of ``n_slots`` slots; without it
    version 1 is made from these rows. Its next version, for one more shard, is the column next_shard. With ``map_path``
    both are stored there, the given one only if it is new.
    """
    scratch = scratch or Scratch(docs.sparkSession, "slots")
    records = docs.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # written, so that a row's part stays the same from here on
    records = scratch.save(records.withColumn("part", F.spark_partition_id()), "records")
    again = F.row_number().over(Window.partitionBy("part", "doc_id", "text_crc32", "size").orderBy("doc_id")) - 1
    row = F.struct("doc_id", "text_crc32", "size")
    slot = F.when(F.col("again") == 0, virtual_slot(row, n_slots)).otherwise(virtual_slot(F.struct(row, "again"), n_slots))
    records = scratch.save(records.withColumn("again", again).withColumn("virtual_slot", slot).drop("again"), "slots")
    parts = scratch.save(records.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "parts")
    totals = scratch.save(slot_totals(parts.withColumnRenamed("bytes", "size"), n_slots, F.sum("n")), "totals")
    one = scratch.save(slot_map.select("virtual_slot", "shard", "version") if slot_map is not None else first_map(totals, n_shards), "map")
    if slot_map is not None and one.select("virtual_slot").distinct().count() != n_slots:
        raise ValueError("the stored map has another number of slots")
    two = scratch.save(grow(one, totals, n_shards), "next-map")
    if map_path:
        for each in ([] if slot_map is not None else [one]) + [two]:
            store_map(each, map_path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        one.join(F.broadcast(totals), "virtual_slot")
        .select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("starts"))
        .join(F.broadcast(two.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")
    )
    earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, ["virtual_slot", "part"])
        .join(F.broadcast(plan), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("starts") + F.col("skip") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("next_shard").cast("int").alias("next_shard"),
        )
    )

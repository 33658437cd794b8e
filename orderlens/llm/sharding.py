"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, one of thousands that never change. Bytes are summed for each slot, and a small map from slot to shard, kept in numbered
versions, says where a slot lies. Rebalancing edits the map: a slot stays where it is while its shard has room, only the rest moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

SLOTS = 4096
#: Bytes that each record takes besides its text.
HEAD = 16


def records(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes of the text plus HEAD; a null text has none), text_crc32 and virtual_slot. Other columns are dropped."""
    return docs.select(
        docs[key].alias(key),
        (F.octet_length(text_of(text)) + HEAD).cast("bigint").alias("size"),
        F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(docs[key]), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """The first version: as many slots in each shard, in order."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map's next version for `shards` shards, with bytes as even as whole slots allow.

    Slots are gone through from the largest. One stays in its shard while that holds no more than the mean; the others then go, again from the largest, to the shard
    that has least. All of it is a fold over one array of `slots` entries, whatever the number of records. A shard beyond `shards` is given up; new ones begin empty.
    """
    one = slot_map.join(sizes, "virtual_slot", "left").agg(
        F.expr("sort_array(collect_list(struct(-coalesce(bytes, 0L) as rest, virtual_slot, shard)))").alias("every"),
        F.expr(f"cast(ceil(sum(coalesce(bytes, 0L)) / {shards}) as bigint)").alias("mean"),
    )
    pair, moved = "array<struct<virtual_slot:int,shard:int>>", "array<struct<rest:bigint,virtual_slot:int,shard:int>>"
    kept = one.select(
        F.expr(f"""aggregate(every,
            named_struct('loads', array_repeat(0L, {shards}), 'placed', cast(array() as {pair}), 'moved', cast(array() as {moved}), 'mean', mean),
            (a, x) -> if(x.shard < {shards} and coalesce(get(a.loads, x.shard), 0L) - x.rest <= a.mean,
                named_struct('loads', transform(a.loads, (v, i) -> if(i = x.shard, v - x.rest, v)), 'placed', concat(a.placed, array(named_struct('virtual_slot', x.virtual_slot, 'shard', x.shard))), 'moved', a.moved, 'mean', a.mean),
                named_struct('loads', a.loads, 'placed', a.placed, 'moved', concat(a.moved, array(x)), 'mean', a.mean)))""").alias("a")
    )
    done = kept.select(
        F.expr("""aggregate(a.moved, named_struct('loads', a.loads, 'placed', a.placed),
            (b, x) -> named_struct(
                'loads', transform(b.loads, (v, i) -> if(i = array_position(b.loads, array_min(b.loads)) - 1, v - x.rest, v)),
                'placed', concat(b.placed, array(named_struct('virtual_slot', x.virtual_slot, 'shard', cast(array_position(b.loads, array_min(b.loads)) - 1 as int))))),
            b -> b.placed)""").alias("placed")
    )
    return done.select(F.inline("placed"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map with one more shard, which takes an equal part of the slots of each other shard; no slot moves between those. The slots decide, not their bytes."""
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.col("virtual_slot"), F.lit(shards)), "virtual_slot"))
    return slot_map.select("virtual_slot", F.when(rank % (shards + 1) == shards, shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def save(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Stores a version of the map, which is never written again, and gives it as stored."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")
    return slot_map.sparkSession.read.parquet(f"{path}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """records() with shard and slot, a record's number in its shard, from 0 without gaps.

    Records are numbered inside their virtual slot by key, ties by digest and size; a slot begins where the slots before it in its shard end. So nothing larger than a
    virtual slot meets in a task. The map, of as many rows as there are virtual slots, is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot", "left").select("virtual_slot", "shard", F.coalesce(F.sum(F.coalesce("rows", F.lit(0))).over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    return rows.withColumn("_number", number).join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("start") + F.col("_number") - 1).cast("bigint")).drop("_number", "start")

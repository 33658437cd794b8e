"""Presentations and training views: seeded orders, injections, chunks, schedules and batches."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffles(sizes: DataFrame, seeds: list[int]) -> DataFrame:
    """(n, seed, i, position): for each pool size n and seed the order of random.Random(seed).shuffle, which depends on nothing else. Orders are made in tasks; one is as long as its pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                for seed in seeds:
                    order = list(range(n))
                    random.Random(seed).shuffle(order)
                    yield pa.RecordBatch.from_pydict({"n": [n] * n, "seed": [seed] * n, "i": order, "position": list(range(n))}, pa.schema([(c, pa.int64()) for c in ("n", "seed", "i", "position")]))

    return sizes.select(F.col("n").cast("bigint").alias("n")).distinct().mapInArrow(run, "n bigint, seed bigint, i bigint, position bigint")


def presented(pool: DataFrame, seeds: list[int]) -> DataFrame:
    """(qid, docid, seed, position): each pool, whatever its size, in each order of its size."""
    sized = pool.withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    table = shuffles(pool.groupBy("qid").agg(F.count("*").alias("n")).select("n"), seeds).withColumnRenamed("n", "_n")
    return sized.join(table, (F.col("n") == F.col("_n")) & (F.col("fs_rank") == F.col("i"))).select("qid", "docid", "seed", "position")


def injected(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, docid, place, position): the target moved to the front, the middle and the end of its pool, the others in order."""
    w = Window.partitionBy("qid")
    rows = pool.join(targets.select("qid", F.col("docid").alias("_t")), "qid").withColumn("n", F.count("*").over(w)).withColumn("_is", F.col("docid") == F.col("_t"))
    rows = rows.withColumn("_rest", F.row_number().over(w.orderBy("_is", "fs_rank")) - 1)
    places = F.explode(F.array(F.struct(F.lit("top").alias("place"), F.lit(0).cast("bigint").alias("at")), F.struct(F.lit("middle").alias("place"), F.floor(F.col("n") / 2).alias("at")), F.struct(F.lit("bottom").alias("place"), (F.col("n") - 1).alias("at"))))
    rows = rows.select("*", places.alias("_p"))
    at = F.col("_p.at")
    return rows.select("qid", "docid", F.col("_p.place").alias("place"), F.when(F.col("_is"), at).when(F.col("_rest") < at, F.col("_rest")).otherwise(F.col("_rest") + 1).cast("bigint").alias("position"))


def rendered(units: DataFrame, separators: list[str], scales: list[str]) -> DataFrame:
    """Units times render variants, in one pass."""
    variants = F.explode(F.array(*(F.struct(F.lit(s).alias("separator"), F.lit(c).alias("scale")) for s in separators for c in scales)))
    return units.withColumn("_v", variants).select(*units.columns, "_v.separator", "_v.scale")


def chunks(presented_rows: DataFrame, width: int) -> DataFrame:
    """(qid, seed, chunk, slot, docid), slots by place in the chunk."""
    return presented_rows.select("qid", "seed", F.floor(F.col("position") / width).alias("chunk"), (F.col("position") % width).alias("slot"), "docid")


def view_seed(qid: Column, chunk: Column, view: Column) -> Column:
    """The first eight bytes of a SHA-1, as DECIMAL(20,0)."""
    return F.conv(F.substring(F.sha1(F.encode(F.concat_ws(":", qid, chunk, view), "UTF-8")), 1, 16), 16, 10).cast("decimal(20,0)")


def two_views(chunk_rows: DataFrame) -> DataFrame:
    """(qid, chunk, view, docid, slot): each chunk in two orders, by hashes of document and view."""
    rows = chunk_rows.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    order = Window.partitionBy("qid", "chunk", "view").orderBy(F.md5(F.concat_ws(":", "docid", "view")), "docid")
    return rows.select("qid", "chunk", "view", "docid", (F.row_number().over(order) - 1).alias("slot"))


def groups(presented_rows: DataFrame) -> DataFrame:
    """(qid, seed, docids): the documents in each order."""
    return presented_rows.groupBy("qid", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "docid"))), lambda x: x["docid"]).alias("docids"))


def schedule(spark: SparkSession, epochs: int, seeds: list[int], widths: list[int]) -> DataFrame:
    """(epoch, seed, width): seeds turn every epoch, chunk sizes every epoch as well."""
    rows = spark.range(epochs).withColumnRenamed("id", "epoch")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("epoch") % len(values) + 1).cast("int"))
    return rows.select("epoch", pick(seeds).alias("seed"), pick(widths).alias("width"))


def padded(rows: DataFrame, key: str, ranks: int) -> DataFrame:
    """Numbered rows, the first ones repeated so that every rank has as many; for the rows of one epoch's chunk table."""
    n = rows.count()
    numbered = rows.withColumn("i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).cast("bigint"))
    again = (-n) % ranks
    extra = numbered.where(F.col("i") < again).withColumn("i", F.col("i") + n)
    return numbered.unionByName(extra).withColumn("rank", F.col("i") % ranks)


def batched(rows: DataFrame, arrangement: int, size: int) -> DataFrame:
    """(key, batch, place): requests in an order by a hash of key and arrangement, cut into batches."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.md5(F.concat_ws(":", "key", F.lit(str(arrangement)))), "key")
    numbered = rows.select("key", (F.row_number().over(order) - 1).alias("_i"))
    return numbered.select("key", F.floor(F.col("_i") / size).alias("batch"), (F.col("_i") % size).alias("place"))


def work_items(pool: DataFrame, prompts: list[str]) -> DataFrame:
    return pool.select("qid", "docid", F.explode(F.array(*map(F.lit, prompts))).alias("prompt"))


def matrix(spark: SparkSession, **dims: list) -> DataFrame:
    """All combinations of a few settings."""
    out = spark.range(1)
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")

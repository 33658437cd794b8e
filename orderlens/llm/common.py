"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is named, on one machine (tests) one of our own; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="orderlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a table in the shared folder, so that a lost executor costs one read."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A cut() whose tables are deleted at the end; what is to outlast them has to be cut by cut() itself."""
    top = f"{checkpoint_dir(spark)}/tables-{uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{top}/{uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(top)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(name: str) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(name: str = "doc_id") -> Column:
    """crc32(id as text) mod 5, the remainder that splits rows into learned from and held out."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")), F.lit(5))


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and, but for single rows that are larger, `size` bytes of strings."""
    length = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            length += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(length), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives memory that a task no longer uses back to the machine, objects that refer to each other included; Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], rows: int = 256, size: int = 1 << 21) -> DataFrame:
    """Arrow batches, in slices of at most `rows` rows and `size` bytes, through a function from lists to lists. make runs once in each task and gives that function; memory is bounded by a slice and its results besides the Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, rows, size):
                got = work(part.to_pydict())
                yield pa.RecordBatch.from_pydict({f.name: pa.array(got[f.name], f.type) for f in arrow}, schema=arrow)
        del work
        release()

    return df.mapInArrow(run, schema)


def counted(texts: DataFrame, items: Callable[[str], list[bytes]], held: int = 300_000) -> DataFrame:
    """word (binary) and c, how often items() gives it over all rows of texts (text). Tasks count what they read, at most `held` words at once, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = list(seen.keys()), list(seen.values())
            for i in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.binary()), pa.array(counts[i : i + 20_000], pa.int64())], schema=schema)

        for batch in batches:
            for text in batch.column(0):
                seen.update(items(text.as_py()))
                if len(seen) > held:
                    yield from out()
                    seen.clear()
        yield from out()
        seen.clear()
        release()

    return texts.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The `limit` rows (word, c) with the greatest c, ties to the least hash of the word; all if there are fewer. counts is read several times, so it should be a table.

    Histograms find what c, and among ties what part of the hashes, has to be reached, so that little more than `limit` rows are sorted, however many partitions counts has.
    To the driver come histograms only: a few thousand octave parts and hash parts, and the different c of one octave part, fewer than a tenth of the square root of all tokens.
    """

    def reached(rows: DataFrame, part: Column, need: int, falling: bool = True) -> tuple[int, int] | None:
        """The first part, from the greatest (or least) on, up to which there are `need` rows, and how many come before it."""
        before = 0
        for at, n in sorted(rows.groupBy(part.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=falling):
            if before + n >= need:
                return at, before
            before += n
        return None

    octave, part, c = F.floor(F.log2("c") * 64), F.pmod(F.xxhash64("word"), F.lit(4096)), F.col("c")
    rows, need = counts, limit
    first = reached(rows, octave, need)
    if first is not None:
        least, before = first
        edge = counts.where(octave == least)
        need -= before
        count, before = reached(edge, c, need)
        until, _ = reached(edge.where(c == count), part, need - before, False)
        rows = counts.where((c > count) | ((c == count) & (part <= until)))
    return rows.orderBy(F.desc("c"), part, "word").limit(limit)


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, spread: list[str], share: int = 1000) -> DataFrame:
    """rows left-joined with groups (a row for each key, which has `count` of the rows) on key, with no key's rows meeting in one task.

    At most `share` keys can have total/share of all rows each; those are broadcast. Rows of other keys meet their group by a shuffle; rows of broadcast or null keys
    are spread over its tasks by the columns `spread`.
    """
    values = [c for c in groups.columns if c not in (key, count)]
    frequent = groups.where(F.col(count) * share >= total).select(F.col(key).alias("_frequent"), *(F.col(c).alias(f"_f_{c}") for c in values))
    rare = groups.where(F.col(count) * share < total).select(F.col(key).cast("string").alias("_rare"), *(F.col(c).alias(f"_r_{c}") for c in values))
    once = rows.join(F.broadcast(frequent), rows[key] == F.col("_frequent"), "left")
    salt = F.concat(F.lit("\u0000"), F.xxhash64(*spread).cast("string"))
    once = once.withColumn("_by", F.when(F.col("_frequent").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(salt))
    both = once.join(rare, F.col("_by") == F.col("_rare"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"_f_{c}", f"_r_{c}").alias(c) for c in values))

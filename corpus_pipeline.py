"""From documents to token ids: each stage works on all that the one before kept.

Toxic documents, near duplicates but one and documents with benchmark passages go; secrets are masked in the texts that stay; the last stage encodes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import bpe, contamination, neardup, secrets, toxicity
from orderlens.llm.common import checkpoint_dir, cut, table
from orderlens.llm.queries import tokenizer_path

#: The settings of Arrow batches, and the rows and bytes that one has at most. Executors hold a batch outside their heap and their Python workers once more, beside what earlier stages left there.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 22}


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, whose session has BATCHES from then on, where it has no smaller ones: rows are read after the stage returns. What a stage gives does not depend on batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        number = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes  # of "64MB" as of "1000"
        for name, most in BATCHES.items():
            if not 0 < number(spark.conf.get(name)) <= most:
                spark.conf.set(name, str(most))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of four fifths of the ids, does not predict to be toxic."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, told by id (which may be null) and text."""
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = cut(found.where("n_hit > 0").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= neardup.FEW else gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask for each secret; n_chars is that of the new text."""
    masked = secrets.redact(docs, ranks=secrets.learn_ranks(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document: little-endian unsigned 32-bit integers."""
    encoded = bpe.encode(docs, tokenizer_path(), keep=["lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The stages learn, sketch and encode; SQL has none of that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each stage's rows are written as Parquet and read again as the next one's documents."""
    docs, top = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs

"""Streams of labels: deduplicated ingestion within a budget, progress by windows, and resuming."""

from __future__ import annotations

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_labels(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of label files; ts becomes a timestamp (in the session's time zone), which watermarks need."""
    reader = spark.readStream.schema(EVENTS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(labels: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first label of each key that arrives; state is dropped once the watermark has passed."""
    return labels.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_cost(labels: DataFrame) -> DataFrame:
    return labels.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("cost"))


def progress(labels: DataFrame, late: str, every: str) -> DataFrame:
    """Labels and failures by windows of event time."""
    return labels.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"))


def sessions(labels: DataFrame, late: str, gap: str) -> DataFrame:
    """Labels of a user without a longer pause."""
    return labels.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def ingest(labels: DataFrame, table: str, checkpoint: str, budget: float | None = None, spark: SparkSession | None = None) -> float:
    """Appends each micro-batch to a table until the budget is spent; returns the cost so far.

    A batch that is run again replaces itself, so a resumed stream writes nothing twice. Once the table's cost reaches the budget, the next batch is refused before it is
    written or committed, so a later run with more budget begins with it.
    """
    spark = spark or labels.sparkSession

    def cost() -> float:
        try:
            return spark.read.parquet(table).agg(F.sum("value")).first()[0] or 0.0
        except AnalysisException:  # nothing is written yet
            return 0.0

    spent, refused = [cost()], []

    def write(batch: DataFrame, number: int) -> None:
        if budget is not None and spent[0] >= budget:
            refused.append(number)
            raise RuntimeError("the budget is spent")
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        spent[0] = cost()

    query = labels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not refused:
            raise
    return spent[0]


def to_table(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, in append mode, and gives the table that it wrote."""
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def totals(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and gives its last state, which must be small."""
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def resumed(work: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, state): reuse what is done with the same fingerprint, do again what differs, do what is missing."""
    d = done.select(key, F.col(fingerprint).alias("_f"))
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_f") == F.col(fingerprint), "reuse").otherwise("mismatch")
    return work.join(d, key, "left").select(key, state.alias("state"))

"""The relations that ranking analytics works on, derived from warehouse tables: candidates, pools, score logs, judgments, labels and downstream outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Presentations of each query, and candidates of a pool.
PRESENTATIONS, DEPTH = 10, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perms(spark: SparkSession) -> DataFrame:
    return spark.range(PRESENTATIONS).toDF("perm_idx")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (qid, docid, base, fs_rank): a customer's orders, dearest first."""
    first = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("docid"), F.col("o_totalprice").alias("base"), (F.row_number().over(first) - 1).cast("bigint").alias("fs_rank"))


def pool(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    return cand(spark, sf_dir).where(F.col("fs_rank") < depth)


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, perm_idx, docid, position, score): each pool under every presentation. The presentations are a handful, so they are exploded, not joined."""
    rows = pool(spark, sf_dir).withColumn("perm_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PRESENTATIONS - 1).cast("bigint"))))
    place = Window.partitionBy("qid", "perm_idx").orderBy((F.col("docid") * (2 * F.col("perm_idx") + 3)) % 1009, "docid")
    shift = F.when(F.col("perm_idx") == 0, F.lit(0.0)).otherwise(((F.col("docid") * (7 + F.col("perm_idx")) + 13 * F.col("perm_idx")) % 101 - 50) / F.lit(200.0))
    return rows.select("qid", "perm_idx", "docid", (F.row_number().over(place) - 1).cast("bigint").alias("position"), (F.col("base") * (1 + shift) / 100000.0).alias("score"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("docid"), F.when(grade == "1", 3).when(grade == "2", 2).when(grade == "3", 1).otherwise(0).alias("rel"))


def ranked(log: DataFrame, *ties: str) -> DataFrame:
    """A score log with rnk, the 0-based rank by score, ties by the columns named (docid if none)."""
    order = Window.partitionBy("qid", "perm_idx").orderBy(F.desc("score"), *(ties or ("docid",)))
    return log.withColumn("rnk", (F.row_number().over(order) - 1).cast("bigint"))


def qdim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, dataset, variant, training_seed) of each query."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("qid"), F.col("r_name").alias("dataset"), F.col("c_mktsegment").alias("variant"), (42 + F.col("c_custkey") % 3).cast("int").alias("training_seed"))


def deep_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of 100 and one to replace a dropped candidate."""
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("docid")).agg(F.max("l_extendedprice").alias("base"))
    return best.withColumn("fs_rank", (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("base"), "docid")) - 1).cast("bigint")).where("fs_rank < 101")


def silver_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four raw teacher scores of each document: (query_id, doc_id, k, score)."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))
    return docs.select("query_id", "doc_id", "k", (((F.col("n_chars") * (F.col("k") + 3)) % 13).cast("double") / 4.0).alias("score"))


def silver_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query_id")).join(labels, "doc_id").select("query_id", "doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("rel"))


def reader_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, perm_idx, prediction, gold): each assistant turn against the conversation's first user turn."""
    turns = table(spark, sf_dir, "conversations")
    gold = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("gold"))
    return turns.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("perm_idx"), F.col("text").alias("prediction")).join(gold, "qid")


def verdict_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Window.partitionBy("user_id", F.col("event_id") % 10).orderBy("event_id")
    events = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    verdict = F.when(F.col("event_type").isin("view", "click"), "SUPPORTED").when(F.col("event_type") == "purchase", "REFUTED").when(F.col("event_type") == "signup", "NEI")
    return events.select(F.col("user_id").alias("qid"), (F.col("event_id") % 10).alias("perm_idx"), verdict.alias("prediction"))

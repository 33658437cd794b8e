"""Self-consistency and rank fusion: order-averaged scores, Borda, reciprocal ranks, Copeland."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def averaged(log: DataFrame, sizes: list[int]) -> DataFrame:
    """Rankings (qid, perm_idx, docid, score, rnk) by the mean of the first K scores, perm_idx being K; documents with fewer scores are left out. All sizes in one pass."""
    rows = log.withColumn("_k", F.explode(F.array(*map(F.lit, sizes)))).where("perm_idx < _k")
    mean = rows.groupBy("qid", "_k", "docid").agg(F.avg("score").alias("score"), F.count("*").alias("n")).where("n = _k")
    order = Window.partitionBy("qid", "_k").orderBy(F.desc("score"), "docid")
    return mean.select("qid", F.col("_k").cast("bigint").alias("perm_idx"), "docid", "score", (F.row_number().over(order) - 1).cast("bigint").alias("rnk"))


def borda(ranking: DataFrame, sizes: list[int]) -> DataFrame:
    """The same by mean ranks over the first K rankings; queries with fewer rankings are left out."""
    n = F.size(F.collect_set("perm_idx").over(Window.partitionBy("qid")))  # no join, which would rank all again and could send a row a query through the driver
    rows = ranking.withColumn("_n", n).withColumn("_k", F.explode(F.array(*map(F.lit, sizes)))).where("perm_idx < _k and _n >= _k")
    mean = rows.groupBy("qid", "_k", "docid").agg(F.avg("rnk").alias("score"))
    order = Window.partitionBy("qid", "_k").orderBy("score", "docid")
    return mean.select("qid", F.col("_k").cast("bigint").alias("perm_idx"), "docid", "score", (F.row_number().over(order) - 1).cast("bigint").alias("rnk"))


def lift(curve: DataFrame, base: float | None, measure: str) -> DataFrame:
    """A curve's measure less that of the base pass; null if either is."""
    return curve.withColumn("lift", F.col(measure) - F.lit(base).cast("double"))


def reciprocal_rank_fusion(ranking: DataFrame, k: int = 60) -> DataFrame:
    """(qid, docid, score, rnk): the sum of 1/(k + rank) over rankings; ties by the first ranking's rank, then docid."""
    fused = ranking.groupBy("qid", "docid").agg(F.sum(1.0 / (k + F.col("rnk") + 1)).alias("score"), F.min_by("rnk", "perm_idx").alias("_first"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "_first", "docid")
    return fused.withColumn("rnk", (F.row_number().over(order) - 1).cast("bigint")).drop("_first")


def copeland(margins: DataFrame, share: float = 1e-3) -> DataFrame:
    """(qid, docid, score) from (qid, a, b, margin): a point for each pair won, half for a tie, and a refinement by summed margins too small to outweigh half a point."""
    both = margins.unionByName(margins.select("qid", F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("margin")).alias("margin")))
    per = both.groupBy("qid", F.col("a").alias("docid")).agg(F.sum(F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)).alias("wins"), F.sum("margin").alias("total"))
    most = F.max(F.abs("total")).over(Window.partitionBy("qid"))
    return per.select("qid", "docid", (F.col("wins") + F.when(most > 0, share * F.col("total") / most).otherwise(0.0)).alias("score"))


def label_average(raw: DataFrame, least: float, most: float) -> DataFrame:
    """(query_id, doc_id, score, n, vector): clamped scores, missing ones taken for the least, averaged; the vector is in the order of k."""
    rows = raw.withColumn("score", F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.lit(least)))))
    return rows.groupBy("query_id", "doc_id").agg(F.avg("score").alias("score"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("vector"))


def vector_average(rows: DataFrame, vector: str = "grades") -> DataFrame:
    """(query_id, doc_id, grades, expected): the element-wise mean of grade vectors, and the expectation of the grade under it."""
    flat = rows.select("query_id", "doc_id", F.posexplode(vector).alias("g", "p"))
    mean = flat.groupBy("query_id", "doc_id", "g").agg(F.avg("p").alias("p"))
    return mean.groupBy("query_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "p"))), lambda x: x["p"]).alias("grades"), F.sum(F.col("g") * F.col("p")).alias("expected"))

"""Ranking quality: the nDCG variants, trec_eval's measures, first-stage diagnostics and pair statistics.

Judgments are (qid, docid, rel), rankings (qid, perm_idx, docid, rnk) with 0-based ranks. All work is grouped by query, so that judgments and rankings meet in one
shuffle on qid that the following windows and aggregates reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def linear(rel: Column) -> Column:
    return rel.cast("double")


def exponential(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def discounted(gain: Column, rank: Column, k: int) -> Column:
    """The sum of gains over 0-based ranks below k, each by log2(rank + 2)."""
    return F.sum(F.when(rank < k, gain / F.log2(rank + 2)).otherwise(0.0))


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rankings with rel; what nobody judged has 0."""
    return ranking.join(qrels, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ideal(qrels: DataFrame, k: int = 10, gain=linear) -> DataFrame:
    """(qid, idcg, n_rel) over all judgments of a query."""
    best = Window.partitionBy("qid").orderBy(F.desc("rel"), "docid")
    rows = qrels.withColumn("_i", F.row_number().over(best) - 1)
    return rows.groupBy("qid").agg(discounted(gain(F.col("rel")), F.col("_i"), k).alias("idcg"), F.sum((F.col("rel") > 0).cast("bigint")).alias("n_rel"))


def ndcg(ranking: DataFrame, qrels: DataFrame, k: int = 10, gain=linear, without: str = "zero") -> DataFrame:
    """(qid, perm_idx, ndcg). Without an ideal: 0 ("zero"), null ("null"), or no row ("drop")."""
    dcg = judged(ranking, qrels).groupBy("qid", "perm_idx").agg(discounted(gain(F.col("rel")), F.col("rnk"), k).alias("dcg"))
    both = dcg.join(ideal(qrels, k, gain), "qid", "inner" if without == "drop" else "left")
    if without == "drop":
        both = both.where("idcg > 0")
    return both.select("qid", "perm_idx", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0 if without == "zero" else None).cast("double")).alias("ndcg"))


def trec_measures(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """ndcg_cut, map, recip_rank and recall at k for each ranking of a judged query, in one pass over the hits."""
    hits = Window.partitionBy("qid", "perm_idx").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged(ranking, qrels).withColumn("_hit", (F.col("rel") > 0).cast("int"))
    rows = rows.withColumn("_precision", F.sum("_hit").over(hits) / (F.col("rnk") + 1))
    sums = rows.groupBy("qid", "perm_idx").agg(
        discounted(linear(F.col("rel")), F.col("rnk"), k).alias("dcg"), F.sum(F.col("_precision") * F.col("_hit")).alias("precisions"),
        F.min(F.when(F.col("_hit") == 1, F.col("rnk"))).alias("first"), F.sum(F.when(F.col("rnk") < k, F.col("_hit")).otherwise(0)).alias("found"),
    )
    both = sums.join(ideal(qrels, k), "qid")
    part = lambda x: F.when(F.col("n_rel") > 0, x / F.col("n_rel")).otherwise(0.0)
    return both.select(
        "qid", "perm_idx", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg_cut"), part(F.col("precisions")).alias("map"),
        F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("recip_rank"), part(F.col("found")).alias("recall"),
    )


def first_wins(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The first row, by line, of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(line))).where("_r = 1").drop("_r")


def over_queries(rows: DataFrame, measures: list[str], *by: str) -> DataFrame:
    """(by, measure, mean, std, n): sample deviation, 0 for one query; nulls and NaN are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.nanvl(F.col(m), F.lit(None).cast("double")).alias("v")) for m in measures)))
    flat = rows.select(*by, pairs.alias("_p")).select(*by, "_p.measure", "_p.v")
    return flat.groupBy(*by, "measure").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count("v").alias("n"))


def first_stage(candidates: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: macro and micro recall at k, the share of queries with a gold document in the first k, and the mean best gold rank."""
    gold = qrels.where("rel > 0").join(candidates.select("qid", "docid", "fs_rank"), ["qid", "docid"], "left")
    per = gold.groupBy("qid").agg(F.count("*").alias("n"), F.count(F.when(F.col("fs_rank") < k, 1)).alias("hit"), F.min("fs_rank").alias("best"))
    return per.agg(F.avg(F.col("hit") / F.col("n")).alias("macro_recall"), (F.sum("hit") / F.sum("n")).alias("micro_recall"), F.avg((F.col("hit") > 0).cast("int")).alias("any_hit"), F.avg("best").alias("mean_best_rank"), F.count("*").alias("n_queries"))


def rank_histogram(candidates: DataFrame, qrels: DataFrame, width: int = 10) -> DataFrame:
    """Gold documents by bands of first-stage ranks."""
    return qrels.where("rel > 0").join(candidates, ["qid", "docid"]).groupBy(F.floor(F.col("fs_rank") / width).alias("band")).agg(F.count("*").alias("n"))


def auc(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, auc): the chance that a positive outscores another candidate, ties for half; null if one side is empty. By rank sums, so no pairs are made."""
    rows = scores.join(qrels, ["qid", "docid"], "left").withColumn("_p", (F.coalesce("rel", F.lit(0)) > 0).cast("int"))
    ties = Window.partitionBy("qid", "score")
    rows = rows.withColumn("_r", F.rank().over(Window.partitionBy("qid").orderBy("score")) + (F.count("*").over(ties) - 1) / 2)
    sums = rows.groupBy("qid").agg(F.sum("_p").alias("p"), F.sum(1 - F.col("_p")).alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("r"))
    return sums.select("qid", F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def pair_accuracy(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, accuracy): of document pairs with unequal grades, the share that scores order the same way, ties for half."""
    rows = scores.join(qrels, ["qid", "docid"], "left").select("qid", "score", F.coalesce("rel", F.lit(0)).alias("rel"))
    # equal (grade, score) rows count once with their number, so pairs are of distinct values
    kinds = rows.groupBy("qid", "rel", "score").agg(F.count("*").alias("n"))
    a, b = (kinds.select("qid", *(F.col(c).alias(f"{c}_{x}") for c in ("rel", "score", "n"))) for x in "ab")
    right = F.when(F.col("score_a") > F.col("score_b"), 1.0).when(F.col("score_a") == F.col("score_b"), 0.5).otherwise(0.0)
    weight = F.col("n_a") * F.col("n_b")
    return a.join(b, "qid").where("rel_a > rel_b").groupBy("qid").agg((F.sum(right * weight) / F.sum(weight)).alias("accuracy"))


def top_agreement(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: the share of queries whose best-scored document is among those with the best grade."""
    best = scores.groupBy("qid").agg(F.min_by("docid", F.struct(-F.col("score"), F.col("docid"))).alias("pick"))
    gold = qrels.withColumn("_r", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("rel")))).where("_r = 1").groupBy("qid").agg(F.collect_set("docid").alias("gold"))
    return best.join(gold, "qid").agg(F.avg(F.array_contains("gold", F.col("pick")).cast("int")).alias("agreement"), F.count("*").alias("n"))

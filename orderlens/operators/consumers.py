"""Downstream consumers: readers' answers, verdicts, selections, and the reductions that tables are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalized_answer

SPECIAL = ("yes", "no", "noanswer")
INVALID = "<INVALID>"


def bag(tokens: Column) -> Column:
    """A map from each token to how often it occurs."""
    return F.map_from_arrays(F.array_distinct(tokens), F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda x: x == t))))


def answer_scores(items: DataFrame) -> DataFrame:
    """items with em and f1 of prediction against gold, on normalised words with their multiplicity; two empty answers are equal; yes, no and noanswer must match as a whole."""
    rows = items.withColumn("_p", normalized_answer(F.coalesce("prediction", F.lit("")))).withColumn("_g", normalized_answer(F.coalesce("gold", F.lit(""))))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    rows = rows.withColumn("_pw", F.array_sort(words("_p"))).withColumn("_gw", F.array_sort(words("_g")))
    # numbering the copies of a word makes the multiset overlap a plain intersection
    numbered = lambda c: F.transform(c, lambda w, i: F.concat_ws(" ", w, (i - F.array_position(c, w) + 1).cast("string")))
    rows = rows.withColumn("_pn", numbered(F.col("_pw"))).withColumn("_gn", numbered(F.col("_gw")))
    common = F.size(F.array_intersect("_pn", "_gn"))
    p, g = F.size("_pw"), F.size("_gw")
    f1 = F.when((p == 0) | (g == 0), (F.col("_p") == F.col("_g")).cast("double")).when((F.col("_p").isin(*SPECIAL) | F.col("_g").isin(*SPECIAL)) & (F.col("_p") != F.col("_g")), 0.0).otherwise(2.0 * common / (p + g))
    return rows.select(*items.columns, (F.col("_p") == F.col("_g")).cast("double").alias("em"), f1.alias("f1"))


def over_golds(scored: DataFrame, *by: str) -> DataFrame:
    """The best em and f1 over gold aliases."""
    return scored.groupBy(*by).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def majority(items: DataFrame, value: Column) -> DataFrame:
    """(qid, answer, votes, n, flip): the most frequent value, ties to the one met first; flip is 1 - votes / n."""
    votes = items.select("qid", "perm_idx", value.alias("answer")).groupBy("qid", "answer").agg(F.count("*").alias("votes"), F.min("perm_idx").alias("_first"))
    per = votes.groupBy("qid").agg(F.min_by("answer", F.struct(-F.col("votes"), F.col("_first"))).alias("answer"), F.max("votes").alias("votes"), F.sum("votes").alias("n"))
    return per.withColumn("flip", 1 - F.col("votes") / F.col("n"))


def reader_per_query(items: DataFrame) -> DataFrame:
    """Per query: mean, least and greatest of em and f1, spreads, those of the canonical (first) presentation, and the answers' flip rate."""
    scored = answer_scores(items)
    agg = scored.groupBy("qid").agg(
        F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("f1").alias("f1"), (F.max("em") - F.min("em")).alias("em_spread"), (F.max("f1") - F.min("f1")).alias("f1_spread"),
        F.min_by("em", "perm_idx").alias("canonical_em"), F.min_by("f1", "perm_idx").alias("canonical_f1"),
    )
    return agg.join(majority(items, normalized_answer(F.col("prediction"))).select("qid", "flip"), "qid")


def verdict(text: Column) -> Column:
    """The one verdict that a reply names; null if it names none or several."""
    low = F.lower(text)
    named = F.array_compact(F.array(F.when(low.rlike(r"\b(supported|supports|true)\b"), "SUPPORTED"), F.when(low.rlike(r"\b(refuted|refutes|false)\b"), "REFUTED"), F.when(low.rlike(r"\b(nei|not enough info|unverifiable)\b"), "NEI")))
    return F.when(F.size(named) == 1, F.element_at(named, 1))


def verdict_per_query(items: DataFrame, gold: Column) -> DataFrame:
    """Per query: accuracy, its spread, share of invalid predictions, and flip rate with invalid as a class of its own."""
    value = F.coalesce("prediction", F.lit(INVALID))
    right = F.coalesce((F.col("prediction") == gold).cast("double"), F.lit(0.0))
    agg = items.withColumn("_r", right).groupBy("qid").agg(F.avg("_r").alias("accuracy"), (F.max("_r") - F.min("_r")).alias("accuracy_spread"), F.avg(F.col("prediction").isNull().cast("int")).alias("invalid"))
    return agg.join(majority(items, value), "qid")


def label_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("prediction", F.lit(INVALID)).alias("label")).agg(F.count("*").alias("n"))


def selections(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query, of what stands first and last in each presentation: pick, quality and pair flip rates, mean quality of the pick, range of the candidates' mean scores."""
    ends = ranking.groupBy("qid", "perm_idx").agg(F.min_by("docid", "rnk").alias("pick"), F.max_by("docid", "rnk").alias("worst"))
    ends = ends.join(qrels.select("qid", F.col("docid").alias("pick"), F.col("rel").alias("quality")), ["qid", "pick"], "left")
    flip = lambda v: majority(ends, v).select("qid", "flip")
    out = ends.groupBy("qid").agg(F.avg("quality").alias("quality"))
    out = out.join(flip(F.col("pick").cast("string")).withColumnRenamed("flip", "pick_flip"), "qid").join(flip(F.col("quality").cast("string")).withColumnRenamed("flip", "quality_flip"), "qid")
    means = ranking.groupBy("qid", "docid").agg(F.avg("score").alias("m")).groupBy("qid").agg((F.max("m") - F.min("m")).alias("score_range"))
    return out.join(flip(F.concat_ws(">", "pick", "worst")).withColumnRenamed("flip", "pair_flip"), "qid").join(means, "qid")


def gold_in_top(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, perm_idx, gold_slot, n_gold): the first gold document among the first k (null if none) and how many there are."""
    top = ranking.where(F.col("rnk") < k).join(qrels.where("rel > 0").select("qid", "docid", F.lit(1).alias("_g")), ["qid", "docid"], "left")
    return top.groupBy("qid", "perm_idx").agg(F.min(F.when(F.col("_g") == 1, F.col("rnk"))).alias("gold_slot"), F.count("_g").alias("n_gold"))


def macro(rows: DataFrame, value: str) -> DataFrame:
    """(variant, mean, sd, n_seeds): means of queries within (variant, seed, dataset), of datasets within a seed, of seeds; sd null for one seed."""
    per = rows.groupBy("variant", "training_seed", "dataset").agg(F.avg(value).alias("v")).groupBy("variant", "training_seed").agg(F.avg("v").alias("v"))
    return per.groupBy("variant").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n_seeds"))


def winners(cells: DataFrame, value: str) -> DataFrame:
    """(variant, wins): datasets in which a variant's value is the greatest; ties win for all."""
    best = F.rank().over(Window.partitionBy("dataset").orderBy(F.desc(F.round(value, 12))))
    return cells.withColumn("_r", best).groupBy("variant").agg(F.count(F.when(F.col("_r") == 1, 1)).alias("wins"))


def discordance(cells: DataFrame, quality: str, instability: str) -> DataFrame:
    """(dataset, best_quality, best_stability, differ): the systems that are best by quality and by stability."""
    per = cells.groupBy("dataset").agg(F.min_by("variant", F.struct(-F.round(quality, 12), F.col("variant"))).alias("best_quality"), F.min_by("variant", F.struct(F.round(instability, 12), F.col("variant"))).alias("best_stability"))
    return per.withColumn("differ", (F.col("best_quality") != F.col("best_stability")).cast("bigint"))


def paired_deltas(values: DataFrame, base: int, other: int) -> DataFrame:
    """(dataset, delta) between two arms, and most, the greatest absolute delta of all."""
    p = values.groupBy("dataset").pivot("arm", [base, other]).agg(F.avg("value"))
    rows = p.select("dataset", (F.col(str(other)) - F.col(str(base))).alias("delta"))
    return rows.join(F.broadcast(rows.agg(F.max(F.abs("delta")).alias("most"))))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order given. Upserts and audits keep what is newest or best."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def parsed_run(run: Column) -> dict[str, Column]:
    """Family, size and recipe of run names like `family-4b-recipe-k10`."""
    return {
        "family": F.regexp_extract(run, r"^([a-z]+\d*)", 1), "size": F.regexp_extract(run, r"-(\d+(?:\.\d+)?)b\b", 1).try_cast("double"),
        "recipe": F.when(run.contains("-sft"), "sft").when(run.contains("-avg"), "averaged").otherwise("base"), "k": F.regexp_extract(run, r"-k(\d+)\b", 1).try_cast("bigint"),
    }

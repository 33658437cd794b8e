"""Sets retained by a threshold on scores: their precision and recall, their stability, and how thresholds are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stability import let, mean_of, mean_tau, tau_psi


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def set_quality(judged_log: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and retention of the documents with score >= tau, for each (by, qid, perm_idx); tau is a column. Zeros for empty sets."""
    kept = (F.col("score") >= F.col("tau")).cast("bigint")
    positive = (F.col("rel") > 0).cast("bigint")
    sums = judged_log.groupBy(*by, "qid", "perm_idx").agg(F.sum(kept).alias("kept"), F.sum(positive).alias("positive"), F.sum(kept * positive).alias("hit"), F.count("*").alias("n"))
    p, r = ratio(F.col("hit"), F.col("kept")), ratio(F.col("hit"), F.col("positive"))
    return sums.select(*by, "qid", "perm_idx", p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("kept"), F.col("n")).alias("retention"))


def spread(quality: DataFrame, *by: str) -> DataFrame:
    """Means and sample deviations (0 for one) over presentations."""
    return quality.groupBy(*by, "qid").agg(*(F.avg(c).alias(f"{c}_mean") for c in ("p", "r", "f1")), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in ("p", "r", "f1")), F.avg("retention").alias("retention"))


def jaccard_of(sets: Column) -> Column:
    """Mean Jaccard over pairs of an array of sets; two empty sets are equal; null below two sets."""
    likeness = lambda a, b: let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n)))
    return mean_of(F.flatten(F.transform(sets, lambda a, i: F.transform(F.slice(sets, i + 2, F.size(sets)), lambda b: likeness(a, b)))))


def retained() -> Column:
    """The documents of a presentation with score >= tau; documents stand once in it."""
    return F.collect_list(F.when(F.col("score") >= F.col("tau"), F.col("docid")))


def jaccard(log: DataFrame, *by: str) -> DataFrame:
    """(by, qid, jaccard): mean Jaccard of the sets over pairs of presentations; two empty sets are equal; no row for one presentation."""
    per = log.groupBy(*by, "qid", "perm_idx").agg(retained().alias("s")).groupBy(*by, "qid").agg(F.collect_list("s").alias("sets"))
    return per.where(F.size("sets") > 1).select(*by, "qid", jaccard_of(F.col("sets")).alias("jaccard"))


def flip_rate(log: DataFrame, *by: str) -> DataFrame:
    """(by, qid, flip_rate): of documents ever retained, the share not always retained; null if none ever is."""
    per = log.groupBy(*by, "qid", "docid").agg(F.avg((F.col("score") >= F.col("tau")).cast("int")).alias("m"))
    return per.groupBy(*by, "qid").agg((F.count(F.when((F.col("m") > 0) & (F.col("m") < 1), 1)) / F.nullif(F.count(F.when(F.col("m") > 0, 1)), F.lit(0))).alias("flip_rate"))


#: What `at_threshold` gives of a query, beside its id.
FIGURES = (
    "jaccard flip_rate p_mean p_std r_mean r_std f1_mean f1_std retention_mean retention_std canonical_p canonical_r canonical_f1 canonical_retention n_retained n_candidates score_variance tau tau_psi"
).split()


def at_threshold(judged_log: DataFrame, first: int = 64) -> DataFrame:
    """(qid, FIGURES) of a ranked and judged log at its column tau, a row a query.

    Set stability, precision, recall, F1 and retention over presentations (means and sample deviations, 0 for one) and of the canonical presentation 0, candidates, the mean
    variance of a document's scores (of those with two), and order instability over presentations below `first`. Jaccard and flip rate need two presentations.
    """
    kept, positive = (F.col("score") >= F.col("tau")).cast("bigint"), (F.col("rel") > 0).cast("bigint")
    sums = judged_log.groupBy("qid", "perm_idx").agg(F.sum(kept).alias("kept"), F.sum(positive).alias("positive"), F.sum(kept * positive).alias("hit"), F.count("*").alias("n"), retained().alias("s"))
    p, r = ratio(F.col("hit"), F.col("kept")), ratio(F.col("hit"), F.col("positive"))
    rows = sums.select("qid", "perm_idx", "s", "n", "kept", p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("kept"), F.col("n")).alias("retention"))
    names = ["p", "r", "f1", "retention"]
    canonical = lambda c: F.max(F.when(F.col("perm_idx") == 0, F.col(c)))
    per = rows.groupBy("qid").agg(
        *(F.avg(c).alias(f"{c}_mean") for c in names), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in names), *(canonical(c).alias(f"canonical_{c}") for c in names),
        canonical("kept").alias("n_retained"), F.max("n").alias("n_candidates"), F.collect_list("s").alias("sets"),
    )
    ever, always = F.size(F.array_distinct(F.flatten("sets"))), F.size(F.aggregate("sets", F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b)))
    several = F.size("sets") > 1
    per = per.withColumn("jaccard", F.when(several, jaccard_of(F.col("sets")))).withColumn("flip_rate", F.when(several & (ever > 0), (ever - always) / ever)).drop("sets")
    variance = judged_log.groupBy("qid", "docid").agg(F.var_pop("score").alias("v"), F.count("score").alias("c")).groupBy("qid").agg(F.avg(F.when(F.col("c") > 1, F.col("v"))).alias("score_variance"))
    taus = mean_tau(judged_log.where(F.col("perm_idx") < first).select("qid", "perm_idx", "docid", "rnk")).withColumn("tau_psi", tau_psi(F.col("tau")))
    return per.join(variance, "qid", "left").join(taus, "qid", "left").select("qid", *FIGURES)


def decoupling(per_query: DataFrame) -> DataFrame:
    """(pair, n, rho): Spearman of set churn, order instability and score variance, two by two, over queries that have all three."""
    rows = per_query.select((1 - F.col("jaccard")).alias("churn"), "tau_psi", F.col("score_variance").alias("variance")).na.drop()
    rows = rows.select(*(F.round(c, 9).alias(c) for c in rows.columns))  # equal values differ by nothing
    pairs = [("churn", "tau_psi"), ("churn", "variance"), ("tau_psi", "variance")]
    both = F.explode(F.array(*(F.struct(F.lit(f"{a}:{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs)))
    return spearman(rows.select(both.alias("_x")).select("_x.*"), "a", "b", "pair")


def grid(log: DataFrame, n: int) -> DataFrame:
    """tau from the least finite score to the greatest in n equal steps, and its number; a table of n rows."""
    bounds = log.where(F.col("score").isNotNull() & ~F.isnan("score")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g")).select("g", (F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (n - 1)).alias("tau"))


def at_grid(log: DataFrame, taus: DataFrame) -> DataFrame:
    """The log once for each tau; the grid is a few rows and is broadcast."""
    return log.join(F.broadcast(taus))


def best_f1(judged_log: DataFrame, taus: DataFrame) -> DataFrame:
    """The tau of the grid with the best mean F1, ties to the higher one."""
    mean = set_quality(at_grid(judged_log, taus), "g", "tau").groupBy("g", "tau").agg(F.avg("f1").alias("f1"))
    return mean.orderBy(F.desc(F.round("f1", 12)), F.desc("tau")).limit(1)


def nearest_retention(judged_log: DataFrame, taus: DataFrame, target: float) -> DataFrame:
    """The tau whose mean retention is nearest the target, ties to the higher one."""
    mean = set_quality(at_grid(judged_log, taus), "g", "tau").groupBy("g", "tau").agg(F.avg("retention").alias("retention"))
    return mean.orderBy(F.round(F.abs(F.col("retention") - target), 12), F.desc("tau")).limit(1)


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1, tied values sharing the mean of theirs."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, rho, n): null below three rows or for a constant side."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_g", F.lit(0))
    ranks = ok.withColumn("_x", average_rank(x, *by, "_g")).withColumn("_y", average_rank(y, *by, "_g"))
    agg = ranks.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("c"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"))
    return agg.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("c")).alias("rho"))


def hash_split(rows: DataFrame, key: str = "qid") -> DataFrame:
    """rows with dev: half of the keys, by a hash of the key, so that no order of keys is needed."""
    return rows.withColumn("dev", F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(2)) == 0)


def repeat_single(log: DataFrame, n: int) -> DataFrame:
    """The canonical presentation's scores under each of n presentations, for scorers whose scores do not depend on the order."""
    return log.where("perm_idx = 0").drop("perm_idx").withColumn("perm_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))

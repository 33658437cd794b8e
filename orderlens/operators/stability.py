"""Order instability: Kendall's tau and tau-PSI, variances over presentations, position buckets, rank-biased overlap and summaries of aligned scores.

A query's log is gathered into one row, from which its figures are computed: nothing is joined but rows of queries, and a query is as large as its pool.
Its presentations are compared through pairs of documents. If s is +1 or -1 by how a presentation orders a pair, the products over all pairs of K presentations
sum to ((sum of s)^2 - K) / 2; so a pair needs one sum over presentations and no comparison of presentations with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def let(value: Column, body) -> Column:
    """body of a value that is computed once, also where lambdas name it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(values: Column) -> Column:
    """The mean of an array's values that are not null; null if there are none."""
    total = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))
    return let(F.array_compact(F.transform(values, lambda x: x.cast("double"))), total)


def quantile_of(values: Column, share: float) -> Column:
    """The linear quantile of a sorted array; null if it is empty."""
    place = share * (F.size(values) - 1)
    low, high = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (place - F.floor(place)))


def by_query(ranking: DataFrame, *figures: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, docs, perms): a row a query; docs are (docid, x, figures), x the (perm_idx, rnk, carried columns) of a document in the order of presentations; figures are aggregates over them."""
    docs = ranking.groupBy("qid", "docid").agg(F.sort_array(F.collect_list(F.struct("perm_idx", "rnk", *carry))).alias("x"), *figures)
    rows = docs.groupBy("qid").agg(F.collect_list(F.struct(*[c for c in docs.columns if c != "qid"])).alias("docs"))
    return rows.withColumn("perms", F.sort_array(F.array_distinct(F.flatten(F.transform("docs", lambda d: d["x"]["perm_idx"])))))


def is_full(docs: Column, perms: Column) -> Column:
    """Whether every presentation has every document."""
    return F.forall(docs, lambda d: F.size(d["x"]) == F.size(perms))


def tau_of(docs: Column, perms: Column) -> Column:
    """Mean Kendall tau of a row of `by_query`."""
    n, k = F.size(docs), F.size(perms)
    after = lambda rows, i: F.slice(rows, i + 2, F.size(rows))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    sign = lambda up: F.when(up, 1).otherwise(-1)
    orders = lambda a, b: F.aggregate(F.zip_with(a["x"]["rnk"], b["x"]["rnk"], lambda x, y: sign(x < y)), F.lit(0), lambda s, x: s + x)
    squares = total(F.transform(docs, lambda a, i: F.aggregate(after(docs, i), F.lit(0.0), lambda s, b: s + F.pow(orders(a, b), F.lit(2)))))
    full = F.when(k > 1, (squares / (n * (n - 1) / 2) - k) / (k * (k - 1)))

    def common(pairs: Column) -> Column:
        rises = lambda x, i: F.aggregate(after(pairs, i), F.lit(0.0), lambda s, y: s + sign((x["a"] < y["a"]) == (x["b"] < y["b"])))
        return F.when(F.size(pairs) > 1, total(F.transform(pairs, rises)) / (F.size(pairs) * (F.size(pairs) - 1) / 2))

    def tau(u: Column, v: Column) -> Column:
        return let(F.filter(F.zip_with(u, v, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda r: r["a"].isNotNull() & r["b"].isNotNull()), common)

    vectors = F.transform(perms, lambda p: F.transform(docs, lambda d: F.get(F.filter(d["x"], lambda y: y["perm_idx"] == p)["rnk"], F.lit(0))))
    lacking = let(vectors, lambda v: mean_of(F.flatten(F.transform(v, lambda a, i: F.transform(after(v, i), lambda b: tau(a, b))))))
    return F.when(n > 1, F.when(is_full(docs, perms), full).otherwise(lacking))


def mean_tau(ranking: DataFrame) -> DataFrame:
    """(qid, tau): mean Kendall tau over pairs of presentations, each on the documents that both have; no row for a query with one document, null if no two presentations share two.

    Where every presentation has every document, sums over pairs of documents give it; of other queries, presentations are compared two by two.
    """
    return by_query(ranking).where(F.size("docs") > 1).select("qid", tau_of(F.col("docs"), F.col("perms")).alias("tau"))


def tau_of_pairs(ranking: DataFrame) -> DataFrame:
    """(qid, perm_a, perm_b, n_common, tau) on the documents that both presentations have; null below two. For logs in which presentations lack documents."""
    a = ranking.select("qid", "docid", F.col("perm_idx").alias("perm_a"), F.col("rnk").alias("ra"))
    b = ranking.select("qid", "docid", F.col("perm_idx").alias("perm_b"), F.col("rnk").alias("rb"))
    both = a.join(b, ["qid", "docid"]).where("perm_a < perm_b").groupBy("qid", "perm_a", "perm_b").agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("r"))
    # in the order of the first presentation, a pair is concordant if the second ranks rise
    rises = F.aggregate(F.transform("r", lambda x, i: F.aggregate(F.slice("r", i + 2, F.greatest(F.size("r") - i - 1, F.lit(0))), F.lit(0), lambda s, y: s + F.when(y["rb"] > x["rb"], 1).otherwise(-1))), F.lit(0), lambda s, x: s + x)
    n = F.size("r")
    return both.select("qid", "perm_a", "perm_b", n.cast("bigint").alias("n_common"), F.when(n > 1, rises / (n * (n - 1) / 2)).alias("tau"))


def tau_psi(tau: Column) -> Column:
    """From 0 (the same order always) to 1 (reversed); null stays null."""
    return F.when(tau.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - tau) / 2)))


def rank_variance(ranking: DataFrame) -> DataFrame:
    """(qid, docid, variance) of ranks, population form, for documents that every presentation of the query ranks."""
    k = ranking.groupBy("qid").agg(F.count_distinct("perm_idx").alias("k"))
    per = ranking.groupBy("qid", "docid").agg(F.var_pop("rnk").alias("variance"), F.count("*").alias("n"))
    return per.join(k, "qid").where("n = k").select("qid", "docid", "variance")


def variance_of(rows: DataFrame, value: str, least: int = 2) -> DataFrame:
    """(qid, docid, variance) of a value over presentations, population form, for documents with `least` of them."""
    return rows.groupBy("qid", "docid").agg(F.var_pop(value).alias("variance"), F.count(value).alias("n")).where(F.col("n") >= least).drop("n")


def bucket(position: Column, n: Column) -> Column:
    """The third of the prompt that a 0-based position lies in."""
    return F.when(position < n / 3, "top").when(position < 2 * n / 3, "middle").otherwise("bottom")


def labelled(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, perm_idx, bucket): where the strongest positive stood in each presentation."""
    n = ranking.groupBy("qid", "perm_idx").agg(F.count("*").alias("n"))
    strongest = qrels.where("rel > 0").join(ranking.select("qid", "docid").distinct(), ["qid", "docid"]).groupBy("qid").agg(F.min_by("docid", F.struct(-F.col("rel"), F.col("docid"))).alias("docid"))
    return ranking.join(strongest, ["qid", "docid"]).join(n, ["qid", "perm_idx"]).select("qid", "perm_idx", bucket(F.col("position"), F.col("n")).alias("bucket"))


def zeng(means: Column) -> Column:
    """1 - least / greatest of an array of bucket means; null below two or without a positive one."""
    return F.when((F.size(means) >= 2) & (F.array_max(means) > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.array_min(means) / F.array_max(means))))


def by_bucket(values: DataFrame, labels: DataFrame, value: str = "ndcg") -> DataFrame:
    """Per query: delta (mean of top and bottom less that of middle, null if a side is empty), the bucket means, and zeng."""
    rows = values.join(labels, ["qid", "perm_idx"])
    side = lambda *names: F.avg(F.when(F.col("bucket").isin(*names), F.col(value)))
    per = rows.groupBy("qid").agg((side("top", "bottom") - side("middle")).alias("delta"), side("top").alias("top"), side("middle").alias("middle"), side("bottom").alias("bottom"))
    return per.withColumn("zeng_psi", zeng(F.array_compact(F.array("top", "middle", "bottom"))))


def zeng_corpus(per_query: DataFrame) -> DataFrame:
    """One row: the corpus value, from the means of the queries' bucket means."""
    means = per_query.agg(F.avg("top").alias("top"), F.avg("middle").alias("middle"), F.avg("bottom").alias("bottom"))
    return means.withColumn("zeng_psi", zeng(F.array_compact(F.array("top", "middle", "bottom"))))


def spread(values: DataFrame, value: str = "ndcg") -> DataFrame:
    """(qid, mean, least, greatest, delta, n) of a value over presentations."""
    return values.groupBy("qid").agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), (F.max(value) - F.min(value)).alias("delta"), F.count(value).alias("n"))


def combined_delta(per_query: DataFrame) -> DataFrame:
    """One row: the mean delta if all queries have it in one form, else null; and the most frequent (then least) number of presentations."""
    modal = per_query.groupBy("k").agg(F.count("*").alias("n")).agg(F.min_by("k", F.struct(-F.col("n"), F.col("k"))).alias("modal_k"))
    all_of = per_query.agg(F.when(F.count_distinct("form") == 1, F.avg("delta")).alias("delta"), F.count_distinct("form").alias("n_forms"), F.count("*").alias("n"))
    return all_of.join(F.broadcast(modal))


def judgments(qrels: DataFrame, k: int) -> DataFrame:
    """(qid, idcg, positives): a row a query; of a document judged twice the higher grade counts."""
    rows = qrels.where("docid is not null").repartition("qid").groupBy("qid", "docid").agg(F.max("rel").alias("rel"))
    per = rows.groupBy("qid").agg(F.sort_array(F.collect_list("rel"), asc=False).alias("rels"), F.map_from_entries(F.collect_list(F.when(F.col("rel") > 0, F.struct("docid", "rel")))).alias("positives"))
    gains = F.transform(F.slice("rels", 1, k), lambda r, i: r / F.log2(i + 2))
    return per.select("qid", F.aggregate(gains, F.lit(0.0), lambda s, x: s + x).alias("idcg"), "positives")


def evaluate(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """All per-query figures of order instability, one row a query, of rankings with scores and positions.

    A query without positive judgments has nDCG 0 and no figures by buckets; a variance needs two presentations of a document, that of ranks documents that all presentations have.
    """
    rows = by_query(ranking, F.var_pop("rnk").alias("vr"), F.var_pop("score").alias("vs"), F.count("score").alias("ns"), carry=("position",)).join(judgments(qrels, k), "qid", "left")
    golds = F.transform(F.filter("docs", lambda d: F.try_element_at(F.col("positives"), d["docid"]).isNotNull()), lambda d: F.struct((-F.try_element_at(F.col("positives"), d["docid"])).alias("loss"), d["docid"].alias("docid"), d["x"].alias("x"), d["vr"].alias("vr")))
    rows = rows.withColumn("golds", golds).withColumn("first", F.array_min("golds"))
    hits = F.flatten(F.transform("golds", lambda g: F.transform(F.filter(g["x"], lambda y: y["rnk"] < k), lambda y: F.struct(y["perm_idx"].alias("p"), (-g["loss"] / F.log2(y["rnk"] + 2)).alias("gain")))))
    dcg = lambda h, p: F.aggregate(F.filter(h, lambda x: x["p"] == p), F.lit(0.0), lambda s, x: s + x["gain"])
    values = let(hits, lambda h: F.transform("perms", lambda p: F.when(F.col("idcg") > 0, dcg(h, p) / F.col("idcg")).otherwise(0.0)))
    held = lambda p: F.when(F.col("full"), F.size("docs")).otherwise(F.size(F.filter("docs", lambda d: F.exists(d["x"], lambda y: y["perm_idx"] == p))))
    places = F.transform("perms", lambda p: F.get(F.transform(F.filter(F.col("first")["x"], lambda y: y["perm_idx"] == p), lambda y: bucket(y["position"], held(p))), F.lit(0)))
    rows = rows.withColumn("full", is_full(F.col("docs"), F.col("perms"))).withColumn("values", values)
    rows = rows.withColumn("placed", F.zip_with(places, F.col("values"), lambda b, v: F.struct(b.alias("b"), v.alias("v"))))
    side = lambda *names: mean_of(F.filter("placed", lambda r: r["b"].isin(*names))["v"])
    variance = lambda docs, field, test: mean_of(F.filter(docs, test)[field])
    out = rows.select(
        "qid", F.size("perms").alias("k"), mean_of(F.col("values")).alias("ndcg"), F.array_min("values").alias("least"), F.array_max("values").alias("greatest"), tau_of(F.col("docs"), F.col("perms")).alias("tau"),
        variance(F.col("docs"), "vr", lambda d: F.size(d["x"]) == F.size("perms")).alias("rank_variance"), variance(F.col("golds"), "vr", lambda g: F.size(g["x"]) > 1).alias("gold_rank_variance"),
        variance(F.col("docs"), "vs", lambda d: d["ns"] > 1).alias("score_variance"), (side("top", "bottom") - side("middle")).alias("delta_stratified"), zeng(F.array_compact(F.array(side("top"), side("middle"), side("bottom")))).alias("zeng_psi"),
    )
    return out.withColumn("delta_range", F.col("greatest") - F.col("least")).withColumn("tau_psi", tau_psi(F.col("tau")))


def overlap_of(lists: Column, depth: int = 10, p: float = 0.9) -> Column:
    """Mean extrapolated overlap of pairs of rankings, each the first `depth` ids in order: (1-p) * sum of A_d p^(d-1) + A_depth p^depth; to the longer one's length if that is less."""
    # a shared document counts from the deeper of its two ranks, m, on; so its part of the sum depends on m and the depth k alone
    part = lambda k, m: (1 - p) * sum(p ** (d - 1) / d for d in range(m, k + 1)) + p**k / k
    parts = F.array(*(F.array(*(F.lit(part(k, m)) for m in range(1, k + 1))) for k in range(1, depth + 1)))

    def overlap(a: Column, b: Column) -> Column:
        row = F.element_at(parts, F.greatest(F.size(a), F.size(b)))
        places = F.transform(a, lambda x, i: F.struct((i + 1).alias("i"), F.array_position(b, x).cast("int").alias("j")))
        return let(row, lambda w: F.aggregate(places, F.lit(0.0), lambda s, r: s + F.when(r["j"] > 0, F.element_at(w, F.greatest(r["i"], r["j"]))).otherwise(0.0)))

    return mean_of(F.flatten(F.transform(lists, lambda a, i: F.transform(F.slice(lists, i + 2, F.size(lists)), lambda b: overlap(a, b)))))


def rank_biased_overlap(ranking: DataFrame, depth: int = 10, p: float = 0.9) -> DataFrame:
    """(qid, rbo): mean `overlap_of` pairs of presentations; no row for one presentation."""
    top = ranking.where(F.col("rnk") < depth).groupBy("qid", "perm_idx").agg(F.sort_array(F.collect_list(F.struct("rnk", "docid"))).alias("x"))
    lists = top.groupBy("qid").agg(F.collect_list(F.col("x")["docid"]).alias("lists")).where(F.size("lists") > 1)
    return lists.select("qid", overlap_of(F.col("lists"), depth, p).alias("rbo"))


def aligned_summary(log: DataFrame, cutoff: int = 10) -> DataFrame:
    """Per query, 21 figures of scores aligned over presentations.

    Variances are of the population: of a document's scores over presentations (residual), after each presentation's mean is taken out (centred), of documents within a
    presentation (dispersion), of documents' mean scores (order). Margins are those of adjacent ranks in each presentation by itself: all, among the first `cutoff`, and
    behind it. Queries without two documents and two presentations, or that lack a score, keep their row, with both counts and else nulls.
    """
    in_perm = Window.partitionBy("qid", "perm_idx")
    order = in_perm.orderBy(F.desc("score"), "docid")
    rows = log.withColumn("rnk", (F.row_number().over(order) - 1).cast("bigint")).withColumn("margin", F.col("score") - F.lead("score").over(order))
    rows = rows.withColumn("pm", F.avg("score").over(in_perm)).withColumn("pv", F.var_pop("score").over(in_perm))
    figures = F.var_pop("score").alias("rv"), F.var_pop(F.col("score") - F.col("pm")).alias("cv"), F.avg("score").alias("dm"), F.count(F.nanvl("score", F.lit(None).cast("double"))).alias("ns")
    rows = by_query(rows, *figures, carry=("margin", "score", "pv")).withColumn("flat", F.flatten("docs.x"))
    ranked = F.transform("docs", lambda d: F.transform(F.filter(d["x"], lambda y: y["rnk"] < cutoff), lambda y: F.struct(y["perm_idx"].alias("p"), y["rnk"].alias("rnk"), d["docid"].alias("docid"))))
    lists = let(F.sort_array(F.flatten(ranked)), lambda top: F.transform("perms", lambda p: F.filter(top, lambda y: y["p"] == p)["docid"]))
    values = lambda test, field="margin": F.sort_array(F.array_compact(F.filter("flat", test)[field]))
    rows = rows.withColumn("all", values(lambda r: F.lit(True))).withColumn("top", values(lambda r: r["rnk"] < cutoff - 1)).withColumn("behind", values(lambda r: r["rnk"] == cutoff - 1)).withColumn("scores", values(lambda r: F.lit(True), "score"))
    aligned = (F.size("docs") > 1) & (F.size("perms") > 1) & is_full(F.col("docs"), F.col("perms")) & F.forall("docs", lambda d: d["ns"] == F.size("perms"))
    c = F.col
    found = {
        "tau_psi": tau_psi(tau_of(c("docs"), c("perms"))), "rbo": let(lists, lambda x: overlap_of(x, cutoff)), "residual_variance": mean_of(c("docs.rv")), "centred_variance": mean_of(c("docs.cv")),
        "dispersion_variance": mean_of(c("flat.pv")), "dispersion": mean_of(F.transform("flat", lambda r: F.sqrt(r["pv"]))), "order_variance": let(mean_of(c("docs.dm")), lambda m: mean_of(F.transform("docs.dm", lambda v: (v - m) * (v - m)))),
        "margin_mean": mean_of(c("all")), "margin_median": quantile_of(c("all"), 0.5), "margin_top_mean": mean_of(c("top")), "margin_top_median": quantile_of(c("top"), 0.5), "margin_cutoff_mean": mean_of(c("behind")),
        "margin_cutoff_median": quantile_of(c("behind"), 0.5), "tie_rate": mean_of(F.transform("all", lambda m: (m == 0).cast("int"))), **{f"p{q}": quantile_of(c("scores"), q / 100) for q in (10, 50, 90)},
    }
    out = rows.select("qid", F.size("docs").alias("n_documents"), F.size("perms").alias("n_presentations"), *(F.when(aligned, v).alias(n) for n, v in found.items()))
    return out.withColumn("rbo_instability", 1 - F.col("rbo")).withColumn("normalized_rmse", F.when(F.col("dispersion_variance") > 0, F.sqrt(F.col("centred_variance") / F.col("dispersion_variance"))))


def invariance(log: DataFrame) -> DataFrame:
    """Per query: mean and median of the documents' sample variances (0 with one presentation)."""
    per = log.groupBy("qid", "docid").agg(F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("v"))
    return per.groupBy("qid").agg(F.avg("v").alias("mean_variance"), F.percentile("v", F.lit(0.5)).alias("median_variance"))


def merge_means(parts: DataFrame, mean: str, n: str, *by: str) -> DataFrame:
    """Means of shards into one, each weighed by its number; shards without a value are left out of both."""
    ok = F.col(mean).isNotNull() & ~F.isnan(mean)
    return parts.groupBy(*by).agg((F.sum(F.when(ok, F.col(mean) * F.col(n))) / F.sum(F.when(ok, F.col(n)))).alias("mean"), F.sum(F.when(ok, F.col(n))).alias("n"))


def curve_shape(points: DataFrame, flat: float = 0.01) -> DataFrame:
    """(series, shape) of values by x: flat, monotone_gain, early_plateau (the last step is flat after a gain) or mixed."""
    step = F.col("y") - F.lag("y").over(Window.partitionBy("series").orderBy("x"))
    rows = points.withColumn("step", step).where("step is not null")
    agg = rows.groupBy("series").agg(F.max(F.abs("step")).alias("most"), F.bool_and(F.col("step") >= -flat).alias("up"), F.max_by("step", "x").alias("last"))
    shape = F.when(F.col("most") <= flat, "flat").when(F.col("up") & (F.col("last") <= flat), "early_plateau").when(F.col("up"), "monotone_gain").otherwise("mixed")
    return agg.select("series", shape.alias("shape"))

"""Queries of order instability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators import stability as t
from ..operators.runs import presentation_study
from ..sources import relations as r
from .contract import RELATIONS, register


def ranking(s, d):
    return r.ranked(r.score_log(s, d))


def ndcg(s, d):
    return q.ndcg(ranking(s, d), r.qrels(s, d))


def buckets(s, d):
    return t.by_bucket(ndcg(s, d), t.labelled(ranking(s, d), r.qrels(s, d)))


RELATIONS["labels_of"] = """SELECT k.qid, k.perm_idx, CASE WHEN k.position < n.n / 3.0 THEN 'top' WHEN k.position < 2 * n.n / 3.0 THEN 'middle' ELSE 'bottom' END AS bucket FROM ranked k
    JOIN (SELECT qid, docid FROM (SELECT q.qid, q.docid, row_number() OVER (PARTITION BY q.qid ORDER BY q.rel DESC, q.docid) AS i FROM qrels q JOIN pool p ON p.qid = q.qid AND p.docid = q.docid WHERE q.rel > 0) WHERE i = 1) g ON g.qid = k.qid AND g.docid = k.docid
    JOIN (SELECT qid, count(*) AS n FROM pool GROUP BY qid) n ON n.qid = k.qid"""
RELATIONS["bucketed"] = """SELECT n.qid, avg(ndcg) FILTER (WHERE bucket <> 'middle') - avg(ndcg) FILTER (WHERE bucket = 'middle') AS delta, avg(ndcg) FILTER (WHERE bucket = 'top') AS top, avg(ndcg) FILTER (WHERE bucket = 'middle') AS middle, avg(ndcg) FILTER (WHERE bucket = 'bottom') AS bottom, count(DISTINCT bucket) AS n_buckets
    FROM ndcg n JOIN labels_of l ON l.qid = n.qid AND l.perm_idx = n.perm_idx GROUP BY n.qid"""
ZENG = "CASE WHEN {n} >= 2 AND greatest(top, middle, bottom) > 0 THEN 1 - least(top, middle, bottom) / greatest(top, middle, bottom) END"
RELATIONS["rank_vars"] = "SELECT r.qid, r.docid, var_pop(r.rnk) AS variance FROM ranked r GROUP BY r.qid, r.docid HAVING count(*) = 10"
RELATIONS["gold_vars"] = "SELECT qid, avg(v) AS v FROM (SELECT r.qid, r.docid, var_pop(r.rnk) AS v FROM judged r WHERE rel > 0 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY qid"
RELATIONS["score_vars"] = "SELECT qid, docid, var_pop(score) AS variance FROM score_log GROUP BY 1, 2 HAVING count(*) >= 2"

register("psi_kendall_tau_pairs", lambda s, d: t.tau_of_pairs(ranking(s, d)), "SELECT x.qid, x.perm_idx AS perm_a, y.perm_idx AS perm_b, (SELECT count(*) FROM pool p WHERE p.qid = x.qid) AS n_common, avg(x.s * y.s) AS tau FROM docpairs x JOIN docpairs y ON x.qid = y.qid AND x.i = y.i AND x.j = y.j AND x.perm_idx < y.perm_idx GROUP BY 1, 2, 3 UNION ALL SELECT p.qid, a.perm_idx, b.perm_idx, 1, NULL FROM (SELECT qid FROM pool GROUP BY qid HAVING count(*) = 1) p JOIN perms a ON true JOIN perms b ON a.perm_idx < b.perm_idx", "qid perm_a perm_b n_common", "tau")
register("psi_mean_tau", lambda s, d: t.mean_tau(ranking(s, d)), "SELECT qid, tau FROM tau", "qid", "tau")
LACKING = "not (docid * 7 + perm_idx * 5 + docid div 3) % 6 = 0"
RELATIONS["lacking"] = "SELECT * FROM ranked WHERE NOT (docid * 7 + perm_idx * 5 + docid // 3) % 6 = 0"
register(
    "psi_mean_tau_lacking", lambda s, d: t.mean_tau(ranking(s, d).where(LACKING)),
    """SELECT n.qid, avg(x.tau) AS tau FROM (SELECT qid FROM lacking GROUP BY qid HAVING count(DISTINCT docid) > 1) n LEFT JOIN
        (SELECT x.qid, avg(x.s * y.s) AS tau FROM (SELECT a.qid, a.perm_idx, a.docid AS i, b.docid AS j, CASE WHEN a.rnk < b.rnk THEN 1 ELSE -1 END AS s FROM lacking a JOIN lacking b ON a.qid = b.qid AND a.perm_idx = b.perm_idx AND a.docid < b.docid) x
        JOIN (SELECT a.qid, a.perm_idx, a.docid AS i, b.docid AS j, CASE WHEN a.rnk < b.rnk THEN 1 ELSE -1 END AS s FROM lacking a JOIN lacking b ON a.qid = b.qid AND a.perm_idx = b.perm_idx AND a.docid < b.docid) y
        ON x.qid = y.qid AND x.i = y.i AND x.j = y.j AND x.perm_idx < y.perm_idx GROUP BY x.qid, x.perm_idx, y.perm_idx) x ON x.qid = n.qid GROUP BY n.qid""",
    "qid", "tau",
)
register("psi_tau_psi", lambda s, d: t.mean_tau(ranking(s, d)).withColumn("tau_psi", t.tau_psi(F.col("tau"))), "SELECT qid, tau, tau_psi FROM psi", "qid", "tau tau_psi")
register("psi_rank_variance", lambda s, d: t.rank_variance(ranking(s, d)), "SELECT qid, docid, variance FROM rank_vars", "qid docid", "variance")
register("psi_gold_rank_variance", lambda s, d: t.variance_of(ranking(s, d).join(r.qrels(s, d).where("rel > 0"), ["qid", "docid"], "left_semi"), "rnk").groupBy("qid").agg(F.avg("variance").alias("v")), "SELECT qid, v FROM gold_vars", "qid", "v")
register("psi_score_variance", lambda s, d: t.variance_of(r.score_log(s, d), "score"), "SELECT qid, docid, variance FROM score_vars", "qid docid", "variance")
register("psi_delta_stratified", buckets, f"SELECT qid, delta, top, middle, bottom, {ZENG.format(n='n_buckets')} AS zeng_psi FROM bucketed", "qid", "delta top middle bottom zeng_psi")
register("psi_delta_range", lambda s, d: t.spread(ndcg(s, d)), "SELECT qid, avg(ndcg) AS mean, min(ndcg) AS least, max(ndcg) AS greatest, max(ndcg) - min(ndcg) AS delta, count(*) AS n FROM ndcg GROUP BY qid", "qid n", "mean least greatest delta")
register("psi_zeng_corpus", lambda s, d: t.zeng_corpus(buckets(s, d)), f"SELECT top, middle, bottom, {ZENG.format(n='3')} AS zeng_psi FROM (SELECT avg(top) AS top, avg(middle) AS middle, avg(bottom) AS bottom FROM bucketed)", "", "top middle bottom zeng_psi")


def mixed_forms(s, d):
    ranges, strata = t.spread(ndcg(s, d)), buckets(s, d).select("qid", F.col("delta").alias("strata"))
    both = ranges.join(strata, "qid", "left")
    return t.combined_delta(both.select(F.coalesce("strata", "delta").alias("delta"), F.when(F.col("strata").isNotNull(), "strata").otherwise("range").alias("form"), F.col("n").alias("k")))


register("psi_combined_delta", mixed_forms, "SELECT CASE WHEN count(DISTINCT form) = 1 THEN avg(delta) END AS delta, count(DISTINCT form) AS n_forms, count(*) AS n, 10 AS modal_k FROM (SELECT coalesce(b.delta, x.delta) AS delta, CASE WHEN b.delta IS NULL THEN 'range' ELSE 'strata' END AS form FROM (SELECT qid, max(ndcg) - min(ndcg) AS delta FROM ndcg GROUP BY qid) x LEFT JOIN bucketed b ON b.qid = x.qid)", "n_forms n modal_k", "delta")
RELATIONS["evaluated"] = f"""SELECT n.qid, n.k, n.ndcg, n.least, n.greatest, n.greatest - n.least AS delta_range, p.tau, p.tau_psi, rv.v AS rank_variance, gv.v AS gold_rank_variance, sv.v AS score_variance, b.delta AS delta_stratified, {ZENG.format(n='b.n_buckets')} AS zeng_psi
    FROM (SELECT qid, count(*) AS k, avg(ndcg) AS ndcg, min(ndcg) AS least, max(ndcg) AS greatest FROM ndcg GROUP BY qid) n LEFT JOIN psi p ON p.qid = n.qid LEFT JOIN (SELECT qid, avg(variance) AS v FROM rank_vars GROUP BY qid) rv ON rv.qid = n.qid
    LEFT JOIN gold_vars gv ON gv.qid = n.qid LEFT JOIN (SELECT qid, avg(variance) AS v FROM score_vars GROUP BY qid) sv ON sv.qid = n.qid LEFT JOIN bucketed b ON b.qid = n.qid"""


def evaluated(s, d):
    return presentation_study(r.score_log(s, d), r.qrels(s, d))


FIGURES = "ndcg least greatest delta_range tau tau_psi rank_variance gold_rank_variance score_variance delta_stratified zeng_psi"
register("psi_evaluate_per_query", evaluated, "SELECT * FROM evaluated", "qid k", FIGURES)
register(
    "psi_evaluate_aggregate", lambda s, d: q.over_queries(evaluated(s, d), FIGURES.split()),
    " UNION ALL ".join(f"SELECT '{m}' AS measure, avg({m}) AS mean, coalesce(stddev_samp({m}), 0) AS std, count({m}) AS n FROM evaluated" for m in FIGURES.split()), "n", "mean std", "measure",
)
RELATIONS["rbos"] = """SELECT qid, avg(rbo) AS rbo FROM (SELECT x.qid, x.pa, x.pb, 0.1 * sum(a * pow(0.9, d - 1)) + max(CASE WHEN d = k THEN a * pow(0.9, k) END) AS rbo FROM (
        SELECT s.qid, s.pa, s.pb, s.k, t.d, (SELECT count(*) FROM ranked u JOIN ranked v ON u.qid = v.qid AND u.docid = v.docid WHERE u.qid = s.qid AND u.perm_idx = s.pa AND v.perm_idx = s.pb AND u.rnk < t.d AND v.rnk < t.d) / CAST(t.d AS DOUBLE) AS a
        FROM (SELECT p.qid, a.perm_idx AS pa, b.perm_idx AS pb, least(10, p.n) AS k FROM (SELECT qid, count(*) AS n FROM pool GROUP BY qid) p JOIN perms a ON true JOIN perms b ON a.perm_idx < b.perm_idx) s, (SELECT range AS d FROM range(1, 11)) t WHERE t.d <= s.k) x GROUP BY 1, 2, 3) GROUP BY qid"""
register("psi_rank_biased_overlap", lambda s, d: t.rank_biased_overlap(ranking(s, d)), "SELECT qid, rbo FROM rbos", "qid", "rbo")
SUMMARY = "tau_psi rbo rbo_instability residual_variance centred_variance dispersion_variance dispersion order_variance normalized_rmse margin_mean margin_median margin_top_mean margin_top_median margin_cutoff_mean margin_cutoff_median tie_rate p10 p50 p90"
RELATIONS["aligned_rows"] = """SELECT *, score - lead(score) OVER (PARTITION BY qid, perm_idx ORDER BY score DESC, docid) AS margin, score - avg(score) OVER (PARTITION BY qid, perm_idx) AS centred FROM ranked
    WHERE qid IN (SELECT qid FROM pool GROUP BY qid HAVING count(*) > 1)"""
register(
    "psi_aligned_summary", lambda s, d: t.aligned_summary(r.score_log(s, d)),
    """SELECT n.qid, n.n AS n_documents, 10 AS n_presentations, p.tau_psi, o.rbo, 1 - o.rbo AS rbo_instability, d.residual_variance, d.centred_variance, v.dispersion_variance, v.dispersion, d.order_variance,
        CASE WHEN dispersion_variance > 0 THEN sqrt(centred_variance / dispersion_variance) END AS normalized_rmse, m.* EXCLUDE (qid) FROM (SELECT qid, count(*) AS n FROM pool GROUP BY qid) n LEFT JOIN psi p ON p.qid = n.qid
        LEFT JOIN (SELECT * FROM rbos WHERE qid IN (SELECT qid FROM pool GROUP BY qid HAVING count(*) > 1)) o ON o.qid = n.qid
        LEFT JOIN (SELECT qid, avg(rv) AS residual_variance, avg(cv) AS centred_variance, var_pop(m) AS order_variance FROM (SELECT qid, docid, var_pop(score) AS rv, var_pop(centred) AS cv, avg(score) AS m FROM aligned_rows GROUP BY 1, 2) GROUP BY qid) d ON d.qid = n.qid
        LEFT JOIN (SELECT qid, avg(v) AS dispersion_variance, avg(sqrt(v)) AS dispersion FROM (SELECT qid, perm_idx, var_pop(score) AS v FROM aligned_rows GROUP BY 1, 2) GROUP BY qid) v ON v.qid = n.qid
        LEFT JOIN (SELECT qid, avg(margin) AS margin_mean, median(margin) AS margin_median, avg(margin) FILTER (WHERE rnk < 9) AS margin_top_mean, median(margin) FILTER (WHERE rnk < 9) AS margin_top_median, avg(margin) FILTER (WHERE rnk = 9) AS margin_cutoff_mean,
            median(margin) FILTER (WHERE rnk = 9) AS margin_cutoff_median, avg(CASE WHEN margin = 0 THEN 1.0 WHEN margin <> 0 THEN 0.0 END) AS tie_rate, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90 FROM aligned_rows GROUP BY qid) m ON m.qid = n.qid""",
    "qid n_documents n_presentations", SUMMARY,
)
register("psi_corpus_tau_psi", lambda s, d: t.mean_tau(ranking(s, d)).agg(F.avg(t.tau_psi(F.col("tau"))).alias("tau_psi"), F.count("tau").alias("n")), "SELECT avg(tau_psi) AS tau_psi, count(tau_psi) AS n FROM psi", "n", "tau_psi")
register("psi_training_invariance", lambda s, d: t.invariance(r.score_log(s, d)), "SELECT qid, avg(v) AS mean_variance, quantile_cont(v, 0.5) AS median_variance FROM (SELECT qid, docid, coalesce(var_samp(score), 0) AS v FROM score_log GROUP BY 1, 2) GROUP BY qid", "qid", "mean_variance median_variance")
register(
    "psi_merge_shards", lambda s, d: t.merge_means(evaluated(s, d).join(r.qdim(s, d), "qid").groupBy("dataset", "training_seed").agg(F.avg("tau_psi").alias("m"), F.count("tau_psi").alias("w")), "m", "w", "dataset"),
    "SELECT dataset, avg(tau_psi) AS mean, count(tau_psi) AS n FROM psi p JOIN qdim q ON q.qid = p.qid GROUP BY dataset", "n", "mean", "dataset",
)
register(
    "psi_tau_shape", lambda s, d: t.curve_shape(q.ndcg(ranking(s, d), r.qrels(s, d)).join(r.qdim(s, d), "qid").groupBy(F.col("dataset").alias("series"), F.col("perm_idx").alias("x")).agg(F.avg("ndcg").alias("y")), 0.002),
    """SELECT dataset AS series, CASE WHEN max(abs(step)) <= 0.002 THEN 'flat' WHEN bool_and(step >= -0.002) AND max_by(step, x) <= 0.002 THEN 'early_plateau' WHEN bool_and(step >= -0.002) THEN 'monotone_gain' ELSE 'mixed' END AS shape
        FROM (SELECT *, y - lag(y) OVER (PARTITION BY dataset ORDER BY x) AS step FROM (SELECT dataset, perm_idx AS x, avg(ndcg) AS y FROM ndcg n JOIN qdim q ON q.qid = n.qid GROUP BY 1, 2)) WHERE step IS NOT NULL GROUP BY dataset""",
    "", "", "series shape",
)

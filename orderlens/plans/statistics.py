"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators import stability as t
from ..operators import statistics as c
from ..operators import thresholds as h
from ..sources import relations as r
from .consumers import per_query
from .contract import RELATIONS, register


def ndcg(s, d):
    return q.ndcg(r.ranked(r.score_log(s, d)), r.qrels(s, d))


def diffs(s, d):
    p = ndcg(s, d).where("perm_idx < 2").groupBy("qid").pivot("perm_idx", [0, 1]).agg(F.max("ndcg"))
    return p.select("qid", F.round(F.col("1") - F.col("0"), 12).alias("v"))  # equal values differ by nothing


def estimates(df):
    """The bootstrap's estimate, which SQL can give, and whether the interval holds it."""
    return df.select("estimate", ((F.col("lo") <= F.col("estimate")) & (F.col("estimate") <= F.col("hi"))).cast("bigint").alias("inside"))


DIFFS = "SELECT a.qid, round(b.ndcg - a.ndcg, 12) AS v FROM ndcg a JOIN ndcg b ON a.qid = b.qid AND a.perm_idx = 0 AND b.perm_idx = 1"
RELATIONS["diffs"] = DIFFS
register("bootstrap_paired", lambda s, d: estimates(c.poisson_bootstrap(diffs(s, d), "v")), "SELECT avg(v) AS estimate, 1 AS inside FROM diffs", "inside", "estimate")
register("bootstrap_hierarchical", lambda s, d: estimates(c.poisson_bootstrap(diffs(s, d).join(r.qdim(s, d), "qid").select("qid", "dataset", "v"), "v", "dataset")), "SELECT avg(m) AS estimate, 1 AS inside FROM (SELECT dataset, avg(v) AS m FROM diffs x JOIN qdim q ON q.qid = x.qid GROUP BY dataset)", "inside", "estimate")
register("bootstrap_three_levels", lambda s, d: estimates(c.poisson_bootstrap(diffs(s, d).join(r.qdim(s, d), "qid").select("qid", "training_seed", "dataset", "v"), "v", "training_seed", "dataset")), "SELECT avg(m) AS estimate, 1 AS inside FROM (SELECT training_seed, dataset, avg(v) AS m FROM diffs x JOIN qdim q ON q.qid = x.qid GROUP BY 1, 2)", "inside", "estimate")
register("bootstrap_exact_generator", lambda s, d: c.exact_bootstrap(diffs(s, d).join(r.qdim(s, d), "qid"), "v", "dataset", 400, 4401), None, "", "mean lo hi")


def tost(s, d):
    agg = diffs(s, d).agg(F.avg("v").alias("m"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))
    return agg.select("m", "se", c.equivalence(F.col("m"), F.col("se"), 0.05).alias("p"))


CDF = "CASE WHEN {z} >= 0 THEN 0.5 * (2 - {poly} * exp(-{z} * {z} / 2)) ELSE 0.5 * {poly} * exp(-{z} * {z} / 2) END"
POLY = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))"


def cdf(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    return CDF.format(z=f"({z})", poly=POLY.replace("t *", f"{t} *").replace("+ t", f"+ {t}"))


register("equivalence_test", tost, f"SELECT m, se, greatest(1 - ({cdf('(m + 0.05) / se')}), {cdf('(m - 0.05) / se')}) AS p FROM (SELECT avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS se FROM diffs)", "", "m se p")


def contrasts(s, d):
    agg = diffs(s, d).join(r.qdim(s, d), "qid").groupBy("dataset").agg(F.avg("v").alias("m"), F.count(F.when(F.col("v") > 0, 1)).alias("wins"), F.count("*").alias("n"), (1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("half"))
    return agg.select("dataset", "m", "wins", F.array_join(c.contrast(F.col("m"), F.col("m") - F.col("half"), F.col("m") + F.col("half"), F.col("wins"), F.col("n")), ",").alias("reasons"))


register(
    "contrast_summary", contrasts,
    "SELECT dataset, m, wins, concat_ws(',', CASE WHEN m - half <= 0 AND m + half >= 0 THEN 'interval_spans_zero' END, CASE WHEN abs(m) < half THEN 'effect_below_half_width' END, CASE WHEN wins * 2 < n THEN 'minority_of_wins' END) AS reasons FROM (SELECT dataset, avg(v) AS m, count(*) FILTER (WHERE v > 0) AS wins, count(*) AS n, 1.96 * stddev_samp(v) / sqrt(count(*)) AS half FROM diffs x JOIN qdim q ON q.qid = x.qid GROUP BY dataset)",
    "wins", "m", "dataset reasons",
)
EDGES = [-1.0, -0.1, -0.03, 0.0, 0.03, 0.1, 1.0]
register(
    "gain_histogram", lambda s, d: c.gain_histogram(diffs(s, d).select(F.round("v", 9).alias("v")), "v", EDGES),
    "SELECT b.bin, count(x.v) AS n FROM (VALUES (0, -1.0, -0.1), (1, -0.1, -0.03), (2, -0.03, 0.0), (3, 0.0, 0.03), (4, 0.03, 0.1), (5, 0.1, 1.0)) b(bin, lo, hi) LEFT JOIN (SELECT round(v, 9) AS v FROM diffs) x ON x.v >= b.lo AND (x.v < b.hi OR (b.bin = 5 AND x.v <= b.hi)) GROUP BY b.bin", "bin n",
)
register(
    "clustered_ols", lambda s, d: c.clustered_ols(per_query(s, d).where("tau_psi is not null"), "tau_psi", "ndcg", "dataset"),
    """SELECT slope, intercept, sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * meat) / sxx AS se, g, n FROM (SELECT sum(u * u) AS meat, count(*) AS g, max(slope) AS slope, max(intercept) AS intercept, max(sxx) AS sxx, max(n) AS n FROM
        (SELECT dataset, sum((c.tau_psi - f.mx) * (c.ndcg - f.intercept - f.slope * c.tau_psi)) AS u, max(slope) AS slope, max(intercept) AS intercept, max(sxx) AS sxx, max(n) AS n FROM cell_rows c, (SELECT avg(tau_psi) AS mx, regr_slope(ndcg, tau_psi) AS slope, regr_intercept(ndcg, tau_psi) AS intercept, regr_sxx(ndcg, tau_psi) AS sxx, count(*) AS n FROM cell_rows WHERE tau_psi IS NOT NULL) f WHERE c.tau_psi IS NOT NULL GROUP BY dataset))""",
    "g n", "slope intercept se",
)
register("spearman_by_variant", lambda s, d: h.spearman(r.table(s, d, "customer").join(r.table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")), "c_acctbal", "o_totalprice", "c_mktsegment"), "SELECT c_mktsegment, count(*) AS n, corr(x, y) AS rho FROM (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY c_mktsegment, o_totalprice) - 1) / 2.0 AS y FROM customer JOIN orders ON c_custkey = o_custkey) GROUP BY 1", "n", "rho", "c_mktsegment")


def two(s, d):
    log = r.score_log(s, d)
    a = log.where("perm_idx = 0").select("qid", "docid", F.col("score").alias("t"))
    return a.join(log.where("perm_idx = 1").select("qid", "docid", F.col("score").alias("p")), ["qid", "docid"])


register("prediction_diagnostics", lambda s, d: c.prediction_diagnostics(two(s, d), "p", "t"), "SELECT avg(pow(b.score - a.score, 2)) AS mse, corr(b.score, a.score) AS pearson, avg(b.score) AS mean, stddev_pop(b.score) AS sd, count(*) AS n FROM score_log a JOIN score_log b ON a.qid = b.qid AND a.docid = b.docid AND a.perm_idx = 0 AND b.perm_idx = 1", "n", "mse pearson mean sd")
register(
    "label_distribution", lambda s, d: c.distribution(r.silver_raw(s, d), "score", 0.0, 3.0, 0.05),
    "SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd, avg(CASE WHEN score <= 0.05 OR score >= 2.95 THEN 1.0 ELSE 0.0 END) AS near_ends, avg(CASE WHEN abs(score - round_even(score, 0)) <= 0.05 THEN 1.0 ELSE 0.0 END) AS near_integers, (SELECT max(c) FROM (SELECT count(*) AS c FROM silver_raw GROUP BY round(score, 6))) / CAST(count(*) AS DOUBLE) AS modal FROM silver_raw",
    "n", "mean sd near_ends near_integers modal",
)


def silver(s, d):
    return r.silver_raw(s, d).join(r.silver_qrels(s, d), ["query_id", "doc_id"])


register("judgment_separation", lambda s, d: c.separation(silver(s, d), "score", F.col("rel") >= 2), "SELECT p AS positive, n AS negative, (p - n) / sqrt((vp + vn) / 2) AS separation FROM (SELECT avg(score) FILTER (WHERE rel >= 2) AS p, avg(score) FILTER (WHERE rel < 2) AS n, var_pop(score) FILTER (WHERE rel >= 2) AS vp, var_pop(score) FILTER (WHERE rel < 2) AS vn FROM silver_raw r JOIN silver_qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id)", "", "positive negative separation")
register("two_presentation_variance", lambda s, d: r.score_log(s, d).where("perm_idx < 2").groupBy("qid", "docid").agg(F.var_pop("score").alias("v")).groupBy("qid").agg(F.avg("v").alias("v")), "SELECT qid, avg(v) AS v FROM (SELECT qid, docid, var_pop(score) AS v FROM score_log WHERE perm_idx < 2 GROUP BY 1, 2) GROUP BY 1", "qid", "v")
# trajectories: a lam is a customer's nation, a step an order, the metric its price
RELATIONS["trajectories"] = "SELECT CAST(c_nationkey AS BIGINT) AS lam, o_orderkey AS step, o_totalprice / 100000.0 AS metric, abs(c_acctbal) / 10000.0 AS sd FROM orders JOIN customer ON c_custkey = o_custkey"


def trajectories(s, d):
    return r.table(s, d, "orders").join(r.table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").cast("bigint").alias("lam"), F.col("o_orderkey").alias("step"), (F.col("o_totalprice") / 100000.0).alias("metric"), (F.abs("c_acctbal") / 10000.0).alias("sd"))


RELATIONS["lam_best"] = "SELECT lam, max(metric) AS best FROM trajectories WHERE sd >= 0.1 GROUP BY lam"
register(
    "lambda_one_standard_error", lambda s, d: c.one_standard_error(trajectories(s, d), 0.1),
    "SELECT max(b.lam) AS lam, max(t.argmax) AS argmax, max(t.top) AS top, count(*) AS n_band FROM lam_best b, (SELECT max(best) AS top, first(lam ORDER BY best DESC, lam) AS argmax, coalesce(stddev_samp(best) / sqrt(count(*)), 0) AS se FROM lam_best) t WHERE b.best >= t.top - t.se", "lam argmax n_band", "top",
)
register("lambda_stability_target", lambda s, d: c.least_matching(trajectories(s, d).groupBy("lam").agg(F.avg("sd").alias("psi")), 0.45), "SELECT min(lam) AS lam FROM (SELECT lam, avg(sd) AS psi FROM trajectories GROUP BY lam) WHERE psi <= 0.45", "lam")
register("checkpoint_best_earliest", lambda s, d: c.best_checkpoints(trajectories(s, d).withColumnRenamed("lam", "run"), 1, False), "SELECT run, step, metric FROM (SELECT lam AS run, step, metric, row_number() OVER (PARTITION BY lam ORDER BY metric DESC, step) AS i FROM trajectories) WHERE i = 1", "run step", "metric")
register("checkpoint_top_n", lambda s, d: c.best_checkpoints(trajectories(s, d).withColumnRenamed("lam", "run"), 3, True), "SELECT run, step, metric, i AS place FROM (SELECT lam AS run, step, metric, row_number() OVER (PARTITION BY lam ORDER BY metric DESC, step DESC) AS i FROM trajectories) WHERE i <= 3", "run step place", "metric")
register("curve_screen", lambda s, d: c.screen(trajectories(s, d).withColumnRenamed("lam", "run"), 1.3, 1.6), "SELECT run, median, CASE WHEN n < 3 THEN 'ABSTAIN' WHEN median < 1.3 THEN 'LOWER' WHEN median > 1.6 THEN 'RAISE' ELSE 'PASS' END AS verdict FROM (SELECT lam AS run, quantile_cont(metric, 0.5) AS median, count(*) AS n FROM trajectories GROUP BY lam)", "run", "median", "verdict")
register("slot_propensity", lambda s, d: c.slot_weights(r.score_log(s, d).join(r.qrels(s, d).where("rel > 0"), ["qid", "docid"]), 10, 1.05), "SELECT slot, n, propensity, w / avg(w) OVER () AS weight FROM (SELECT *, least(1.05, 1 / (10 * propensity)) AS w FROM (SELECT slot, n, (n + 1) / sum(n + 1) OVER () AS propensity FROM (SELECT position % 10 AS slot, CAST(count(*) AS DOUBLE) AS n FROM judged WHERE rel > 0 GROUP BY 1)))", "slot n", "propensity weight")
register("prompt_length_profile", lambda s, d: c.prompt_percentiles(r.table(s, d, "documents"), "n_chars", [50, 95, 99]), "SELECT s AS share, min(v) AS value FROM (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS t FROM documents), (VALUES (50), (95), (99)) p(s) WHERE i >= round_even(s / 100.0 * (t - 1), 0) GROUP BY s", "share value")
register("cost_state", lambda s, d: c.cost_state(r.table(s, d, "events")), "SELECT event_type AS kind, count(*) AS n, sum(value) AS cost, count(DISTINCT user_id) AS users, sum(value) / count(DISTINCT user_id) AS cost_per_user, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1", "n users failures", "cost cost_per_user", "kind", digits=4)
register("invariance_spearman", lambda s, d: h.spearman(t.invariance(r.score_log(s, d)).join(ndcg(s, d).where("perm_idx = 0"), "qid").select(F.round("mean_variance", 9).alias("a"), F.round("ndcg", 9).alias("b")), "a", "b"), "SELECT count(*) AS n, corr(x, y) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM (SELECT round(v, 9) AS a, round(ndcg, 9) AS b FROM (SELECT qid, avg(v) AS v FROM (SELECT qid, docid, var_samp(score) AS v FROM score_log GROUP BY 1, 2) GROUP BY 1) i JOIN ndcg n ON n.qid = i.qid AND n.perm_idx = 0))", "n", "rho")

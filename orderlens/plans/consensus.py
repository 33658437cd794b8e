"""Queries of self-consistency, fusion and retained sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as c
from ..operators import quality as q
from ..operators import thresholds as h
from ..sources import relations as r
from .contract import RELATIONS, register

SIZES = [1, 3, 5, 10]
RELATIONS["averaged"] = "SELECT qid, k AS perm_idx, docid, score, row_number() OVER (PARTITION BY qid, k ORDER BY score DESC, docid) - 1 AS rnk FROM (SELECT s.qid, v.k, s.docid, avg(s.score) AS score FROM score_log s JOIN (VALUES (1), (3), (5), (10)) v(k) ON s.perm_idx < v.k GROUP BY 1, 2, 3 HAVING count(*) = v.k)"
RELATIONS["borda"] = "SELECT qid, k AS perm_idx, docid, score, row_number() OVER (PARTITION BY qid, k ORDER BY score, docid) - 1 AS rnk FROM (SELECT s.qid, v.k, s.docid, avg(s.rnk) AS score FROM ranked s JOIN (VALUES (1), (3), (5), (10)) v(k) ON s.perm_idx < v.k GROUP BY 1, 2, 3)"
CURVE = "SELECT a.perm_idx, avg(CASE WHEN i.idcg > 0 THEN d / i.idcg ELSE 0 END) AS ndcg, count(*) AS n FROM (SELECT x.qid, x.perm_idx, sum(CASE WHEN rnk < 10 THEN coalesce(q.rel, 0) / log2(rnk + 2) ELSE 0 END) AS d FROM {} x LEFT JOIN qrels q ON q.qid = x.qid AND q.docid = x.docid GROUP BY 1, 2) a JOIN ideal i ON i.qid = a.qid GROUP BY 1"


def log(s, d):
    return r.score_log(s, d)


def curve(ranking, s, d):
    return q.ndcg(ranking, r.qrels(s, d)).groupBy("perm_idx").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n"))


register("consensus_averaged_ranking", lambda s, d: c.averaged(log(s, d), SIZES), "SELECT * FROM averaged", "qid perm_idx docid rnk", "score")
register("consensus_score_curve", lambda s, d: curve(c.averaged(log(s, d), SIZES), s, d), CURVE.format("averaged"), "perm_idx n", "ndcg")
register("consensus_borda", lambda s, d: c.borda(r.ranked(log(s, d)), SIZES), "SELECT * FROM borda", "qid perm_idx docid rnk", "score")
register("consensus_rank_curve", lambda s, d: curve(c.borda(r.ranked(log(s, d)), SIZES), s, d), CURVE.format("borda"), "perm_idx n", "ndcg")


def lifted(s, d):
    points = curve(c.averaged(log(s, d), SIZES), s, d)
    base = points.where("perm_idx = 1").select(F.col("ndcg").alias("base"))
    return points.join(F.broadcast(base)).select("perm_idx", (F.col("ndcg") - F.col("base")).alias("lift"))


register("consensus_lift", lifted, f"SELECT a.perm_idx, a.ndcg - b.ndcg AS lift FROM ({CURVE.format('averaged')}) a, ({CURVE.format('averaged')}) b WHERE b.perm_idx = 1", "perm_idx", "lift")
register(
    "consensus_reciprocal_rank_fusion", lambda s, d: c.reciprocal_rank_fusion(r.ranked(log(s, d))),
    "SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, docid) - 1 AS rnk FROM (SELECT qid, docid, sum(1.0 / (61 + rnk)) AS score, min_by(rnk, perm_idx) AS first FROM ranked GROUP BY 1, 2)", "qid docid rnk", "score",
)


def margins(s, d):
    one = log(s, d).where("perm_idx = 0").select("qid", F.col("docid").alias("a"), F.col("score").alias("x"))
    two = log(s, d).where("perm_idx = 1").select("qid", F.col("docid").alias("b"), F.col("score").alias("y"))
    return one.join(two, "qid").where("a < b").select("qid", "a", "b", (F.col("x") - F.col("y")).alias("margin"))


register(
    "consensus_copeland", lambda s, d: c.copeland(margins(s, d)),
    """SELECT qid, docid, wins + CASE WHEN max(abs(total)) OVER (PARTITION BY qid) > 0 THEN 0.001 * total / max(abs(total)) OVER (PARTITION BY qid) ELSE 0 END AS score FROM (SELECT qid, a AS docid, sum(CASE WHEN m > 0 THEN 1.0 WHEN m = 0 THEN 0.5 ELSE 0 END) AS wins, sum(m) AS total FROM
        (SELECT x.qid, CASE WHEN o = 0 THEN x.docid ELSE y.docid END AS a, CASE WHEN o = 0 THEN x.score - y.score ELSE y.score - x.score END AS m FROM score_log x JOIN score_log y ON x.qid = y.qid AND x.docid < y.docid AND x.perm_idx = 0 AND y.perm_idx = 1, (VALUES (0), (1)) v(o)) GROUP BY 1, 2)""",
    "qid docid", "score",
)
register(
    "consensus_label_average", lambda s, d: c.label_average(r.silver_raw(s, d), 0.5, 2.5).select("query_id", "doc_id", "score", "n", F.array_join("vector", ",").alias("v")).drop("v"),
    "SELECT query_id, doc_id, avg(least(2.5, greatest(0.5, score))) AS score, count(*) AS n FROM silver_raw GROUP BY 1, 2", "doc_id n", "score", "query_id",
)


def grade_vectors(s, d):
    return r.silver_raw(s, d).select("query_id", "doc_id", F.array(F.col("score") / 4, 1 - F.col("score") / 4).alias("grades"))


register(
    "consensus_vector_average", lambda s, d: c.vector_average(grade_vectors(s, d)).select("query_id", "doc_id", "expected", F.element_at("grades", 1).alias("p0"), F.element_at("grades", 2).alias("p1")),
    "SELECT query_id, doc_id, avg(1 - score / 4) AS expected, avg(score / 4) AS p0, avg(1 - score / 4) AS p1 FROM silver_raw GROUP BY 1, 2", "doc_id", "expected p0 p1", "query_id",
)

# retained sets
TAU = 1.5


def judged(s, d):
    return q.judged(log(s, d), r.qrels(s, d)).withColumn("tau", F.lit(TAU))


SETS = "SELECT {by} qid, perm_idx, CASE WHEN kept > 0 THEN hit / kept ELSE 0 END AS p, CASE WHEN pos > 0 THEN hit / pos ELSE 0 END AS r, CASE WHEN kept + pos > 0 THEN 2 * hit / (kept + pos) ELSE 0 END AS f1, kept / n AS retention FROM (SELECT {by} qid, perm_idx, CAST(count(*) FILTER (WHERE score >= tau) AS DOUBLE) AS kept, CAST(count(*) FILTER (WHERE rel > 0) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE score >= tau AND rel > 0) AS DOUBLE) AS hit, CAST(count(*) AS DOUBLE) AS n FROM {rows} GROUP BY ALL)"
RELATIONS["fixed_tau"] = f"SELECT *, CAST({TAU} AS DOUBLE) AS tau FROM judged"
RELATIONS["set_rows"] = SETS.format(by="", rows="fixed_tau")
RELATIONS["taus"] = "SELECT CAST(range AS BIGINT) AS g, lo + range * (hi - lo) / 19 AS tau FROM (SELECT min(score) AS lo, max(score) AS hi FROM score_log), range(20)"
RELATIONS["grid_rows"] = SETS.format(by="g, tau,", rows="(SELECT j.*, t.g, t.tau FROM judged j CROSS JOIN taus t WHERE j.perm_idx = 0)")
RELATIONS["jaccards"] = """SELECT s.qid, avg(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END) AS jaccard
    FROM (SELECT x.qid, x.s AS a, y.s AS b FROM (SELECT qid, perm_idx, coalesce(list(docid) FILTER (WHERE score >= tau), []) AS s FROM fixed_tau GROUP BY 1, 2) x JOIN (SELECT qid, perm_idx, coalesce(list(docid) FILTER (WHERE score >= tau), []) AS s FROM fixed_tau GROUP BY 1, 2) y ON x.qid = y.qid AND x.perm_idx < y.perm_idx) s GROUP BY s.qid"""
RELATIONS["flips"] = "SELECT qid, count(*) FILTER (WHERE m > 0 AND m < 1) / CAST(nullif(count(*) FILTER (WHERE m > 0), 0) AS DOUBLE) AS flip_rate FROM (SELECT qid, docid, avg(CASE WHEN score >= tau THEN 1.0 ELSE 0.0 END) AS m FROM fixed_tau GROUP BY 1, 2) GROUP BY 1"
register("threshold_set_quality", lambda s, d: h.set_quality(judged(s, d)), "SELECT * FROM set_rows", "qid perm_idx", "p r f1 retention")
register(
    "threshold_spread", lambda s, d: h.spread(h.set_quality(judged(s, d))),
    "SELECT qid, avg(p) AS p_mean, avg(r) AS r_mean, avg(f1) AS f1_mean, coalesce(stddev_samp(p), 0) AS p_std, coalesce(stddev_samp(r), 0) AS r_std, coalesce(stddev_samp(f1), 0) AS f1_std, avg(retention) AS retention FROM set_rows GROUP BY qid", "qid", "p_mean r_mean f1_mean p_std r_std f1_std retention",
)
register("threshold_jaccard", lambda s, d: h.jaccard(judged(s, d)), "SELECT * FROM jaccards", "qid", "jaccard")
register("threshold_flip_rate", lambda s, d: h.flip_rate(judged(s, d)), "SELECT * FROM flips", "qid", "flip_rate")
register("threshold_grid", lambda s, d: h.grid(log(s, d), 20), "SELECT * FROM taus", "g", "tau")


def canonical(s, d):
    return judged(s, d).drop("tau").where("perm_idx = 0")


register("threshold_tune_f1", lambda s, d: h.best_f1(canonical(s, d), h.grid(log(s, d), 20)), "SELECT g, tau, avg(f1) AS f1 FROM grid_rows GROUP BY 1, 2 ORDER BY round(avg(f1), 12) DESC, tau DESC LIMIT 1", "g", "tau f1")
register("threshold_tune_retention", lambda s, d: h.nearest_retention(canonical(s, d), h.grid(log(s, d), 20), 0.4), "SELECT g, tau, avg(retention) AS retention FROM grid_rows GROUP BY 1, 2 ORDER BY round(abs(avg(retention) - 0.4), 12), tau DESC LIMIT 1", "g", "tau retention")
register(
    "threshold_sweep", lambda s, d: h.set_quality(h.at_grid(canonical(s, d), h.grid(log(s, d), 20)), "g", "tau").groupBy("g", "tau").agg(*(F.avg(m).alias(m) for m in ("p", "r", "f1", "retention"))),
    "SELECT g, tau, avg(p) AS p, avg(r) AS r, avg(f1) AS f1, avg(retention) AS retention FROM grid_rows GROUP BY 1, 2", "g", "tau p r f1 retention",
)


def frozen(s, d):
    return h.at_threshold(q.judged(r.ranked(log(s, d)), r.qrels(s, d)).withColumn("tau", F.lit(TAU)))


RELATIONS["frozen_rows"] = """SELECT s.*, j.jaccard, f.flip_rate, v.score_variance, p.tau, p.tau_psi FROM (SELECT qid, avg(p) AS p_mean, avg(r) AS r_mean, avg(f1) AS f1_mean, avg(retention) AS retention_mean, coalesce(stddev_samp(p), 0) AS p_std, coalesce(stddev_samp(r), 0) AS r_std, coalesce(stddev_samp(f1), 0) AS f1_std,
    coalesce(stddev_samp(retention), 0) AS retention_std, max(p) FILTER (WHERE perm_idx = 0) AS canonical_p, max(r) FILTER (WHERE perm_idx = 0) AS canonical_r, max(f1) FILTER (WHERE perm_idx = 0) AS canonical_f1, max(retention) FILTER (WHERE perm_idx = 0) AS canonical_retention FROM set_rows GROUP BY qid) s
    LEFT JOIN jaccards j ON j.qid = s.qid LEFT JOIN flips f ON f.qid = s.qid LEFT JOIN psi p ON p.qid = s.qid LEFT JOIN (SELECT qid, avg(variance) AS score_variance FROM (SELECT qid, docid, var_pop(score) AS variance FROM score_log GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY qid) v ON v.qid = s.qid"""
RELATIONS["frozen_all"] = "SELECT f.*, n.n_candidates, n.n_retained FROM frozen_rows f JOIN (SELECT qid, count(*) AS n_candidates, count(*) FILTER (WHERE score >= tau) AS n_retained FROM fixed_tau WHERE perm_idx = 0 GROUP BY qid) n ON n.qid = f.qid"
register("threshold_at_frozen_per_query", frozen, f"SELECT qid, {', '.join(h.FIGURES)} FROM frozen_all", "qid n_retained n_candidates", " ".join(f for f in h.FIGURES if f[:2] != "n_"))
register(
    "threshold_evaluate_frozen", lambda s, d: q.over_queries(frozen(s, d), h.FIGURES),
    " UNION ALL ".join(f"SELECT '{m}' AS measure, avg({m}) AS mean, coalesce(stddev_samp({m}), 0) AS std, count({m}) AS n FROM frozen_all" for m in h.FIGURES), "n", "mean std", "measure",
)
CHURN = "SELECT round(1 - jaccard, 9) AS churn, round(tau_psi, 9) AS tau_psi, round(score_variance, 9) AS variance FROM frozen_all WHERE jaccard IS NOT NULL AND tau_psi IS NOT NULL AND score_variance IS NOT NULL"
RELATIONS["churns"] = CHURN
RANKS = "SELECT '{a}:{b}' AS pair, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM churns)"
register("threshold_decoupling_spearman", lambda s, d: h.decoupling(frozen(s, d)), " UNION ALL ".join(RANKS.format(a=a, b=b) for a, b in (("churn", "tau_psi"), ("churn", "variance"), ("tau_psi", "variance"))), "n", "rho", "pair", digits=9)
register("threshold_repeat_single", lambda s, d: h.repeat_single(log(s, d), 3).groupBy("qid", "perm_idx").agg(F.sum("score").alias("total"), F.count("*").alias("n")), "SELECT s.qid, g.perm_idx, sum(score) AS total, count(*) AS n FROM score_log s, perms g WHERE s.perm_idx = 0 AND g.perm_idx < 3 GROUP BY 1, 2", "qid perm_idx n", "total")


def reduced(s, d):
    """Half of the queries choose the threshold, the other half is evaluated at it."""
    rows = h.hash_split(judged(s, d).drop("tau"))
    best = h.best_f1(rows.where("dev and perm_idx = 0"), h.grid(log(s, d), 20)).select("tau")
    test = rows.where("not dev").join(F.broadcast(best))
    return h.spread(h.set_quality(test)).join(h.jaccard(test), "qid").select("qid", "f1_mean", "jaccard")


register("threshold_dev_test_reduction", reduced, None, "qid", "f1_mean jaccard")


def matched(s, d):
    """Each variant's threshold is the one whose retention is nearest that of the first variant at TAU."""
    rows = judged(s, d).join(r.qdim(s, d).select("qid", "variant"), "qid").where("perm_idx = 0")
    target = h.set_quality(rows.where("variant = 'AUTOMOBILE'")).agg(F.avg("retention").alias("target"))
    grid = h.set_quality(h.at_grid(rows.drop("tau"), h.grid(log(s, d), 20)), "variant", "g", "tau").groupBy("variant", "g", "tau").agg(F.avg("retention").alias("retention"), F.avg("f1").alias("f1"))
    near = grid.join(F.broadcast(target)).groupBy("variant").agg(F.min_by(F.struct("tau", "retention", "f1"), F.struct(F.round(F.abs(F.col("retention") - F.col("target")), 12), -F.col("tau"))).alias("x"))
    return near.select("variant", "x.*")


register(
    "threshold_matched_retention", matched,
    "SELECT variant, tau, retention, f1 FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY round(abs(retention - target), 12), tau DESC) AS i FROM (SELECT q.variant, g.tau, avg(g.retention) AS retention, avg(g.f1) AS f1 FROM grid_rows g JOIN qdim q ON q.qid = g.qid GROUP BY 1, 2), (SELECT avg(retention) AS target FROM set_rows s JOIN qdim q ON q.qid = s.qid WHERE perm_idx = 0 AND variant = 'AUTOMOBILE')) WHERE i = 1",
    "", "tau retention f1", "variant",
)

"""Queries of pool, width, context and variance decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decomposition as c
from ..operators import consensus
from ..operators import quality as q
from ..operators import stability as t
from ..sources import relations as r
from .contract import RELATIONS, register

RELATIONS["pools"] = """SELECT qid, docid, arm, row_number() OVER (PARTITION BY qid, arm ORDER BY r) - 1 AS rank FROM (
    SELECT p.qid, p.docid, a.arm, CASE WHEN fs_rank = 100 THEN qid % n ELSE fs_rank END AS r FROM (SELECT *, sum(CASE WHEN fs_rank < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS n FROM deep_pool) p, (VALUES ('canonical'), ('drop'), ('replace')) a(arm)
    WHERE (fs_rank < 100 AND fs_rank <> qid % n) OR (fs_rank < 100 AND a.arm = 'canonical') OR (fs_rank = 100 AND a.arm = 'replace'))"""
RELATIONS["pool_scored"] = "SELECT *, row_number() OVER (PARTITION BY qid, arm ORDER BY (docid * (CASE arm WHEN 'canonical' THEN 7 ELSE 7 + rank % 2 END)) % 997, docid) - 1 AS rnk FROM pools"
RELATIONS["pool_changes"] = """SELECT t.qid, t.arm, t.n_common, p.tau, CASE WHEN p.tau IS NOT NULL THEN least(1, greatest(0, (1 - p.tau) / 2)) END AS pool_psi, t.moved AS top_changed FROM
    (SELECT o.qid, o.arm, count(*) AS n_common, max(CASE WHEN (b.rnk < 10) <> (o.rnk < 10) THEN 1 ELSE 0 END) AS moved FROM pool_scored o JOIN pool_scored b ON b.qid = o.qid AND b.docid = o.docid AND b.arm = 'canonical' AND o.arm <> 'canonical' GROUP BY 1, 2) t
    LEFT JOIN (SELECT x.qid, x.arm, avg(CASE WHEN x.rb < y.rb THEN 1.0 ELSE -1.0 END) AS tau FROM (SELECT o.qid, o.arm, b.rnk AS ra, o.rnk AS rb FROM pool_scored o JOIN pool_scored b ON b.qid = o.qid AND b.docid = o.docid AND b.arm = 'canonical' AND o.arm <> 'canonical') x
        JOIN (SELECT o.qid, o.arm, b.rnk AS ra, o.rnk AS rb FROM pool_scored o JOIN pool_scored b ON b.qid = o.qid AND b.docid = o.docid AND b.arm = 'canonical' AND o.arm <> 'canonical') y ON x.qid = y.qid AND x.arm = y.arm AND x.ra < y.ra GROUP BY 1, 2) p ON p.qid = t.qid AND p.arm = t.arm"""


def pools(s, d):
    return c.fixed_pools(r.deep_pool(s, d))


def rescored(s, d):
    factor = F.when(F.col("arm") == "canonical", F.lit(7)).otherwise(7 + F.col("rank") % 2)
    order = Window.partitionBy("qid", "arm").orderBy((F.col("docid") * factor) % 997, "docid")
    return pools(s, d).withColumn("rnk", F.row_number().over(order) - 1)


register("pool_build", pools, "SELECT * FROM pools", "qid docid rank", "", "arm")
register("pool_change", lambda s, d: c.pool_change(rescored(s, d)), "SELECT * FROM pool_changes", "qid n_common top_changed", "tau pool_psi", "arm")
register("pool_aggregate", lambda s, d: q.over_queries(c.pool_change(rescored(s, d)), ["tau", "pool_psi", "top_changed"], "arm"), " UNION ALL ".join(f"SELECT arm, '{m}' AS measure, avg({m}) AS mean, coalesce(stddev_samp({m}), 0) AS std, count({m}) AS n FROM pool_changes GROUP BY arm" for m in ("tau", "pool_psi", "top_changed")), "n", "mean std", "arm measure")


def log(s, d):
    return r.score_log(s, d)


def ndcg(s, d):
    return q.ndcg(r.ranked(log(s, d)), r.qrels(s, d))


register(
    "matched_variance", lambda s, d: c.matched_variance(ndcg(s, d), q.ndcg(consensus.averaged(log(s, d), [10]), r.qrels(s, d))),
    """SELECT n.qid, avg(n.ndcg) AS single, var_pop(n.ndcg) AS variance, max(n.ndcg) - min(n.ndcg) AS extent, max(a.ndcg) AS averaged FROM ndcg n JOIN
        (SELECT x.qid, CASE WHEN max(i.idcg) > 0 THEN sum(CASE WHEN rnk < 10 THEN coalesce(q.rel, 0) / log2(rnk + 2) ELSE 0 END) / max(i.idcg) ELSE 0 END AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) - 1 AS rnk FROM (SELECT qid, docid, avg(score) AS score FROM score_log GROUP BY 1, 2)) x LEFT JOIN qrels q ON q.qid = x.qid AND q.docid = x.docid JOIN ideal i ON i.qid = x.qid GROUP BY 1) a ON a.qid = n.qid GROUP BY n.qid""",
    "qid", "single variance extent averaged",
)
register("composition_digest", lambda s, d: c.digest(c.slots(log(s, d), 5), "qid", "perm_idx", "chunk"), "SELECT qid, perm_idx, position // 5 AS chunk, substr(sha256(array_to_string(list_sort(list(CAST(docid AS VARCHAR))), chr(10))), 1, 16) AS digest FROM score_log GROUP BY 1, 2, 3", "qid perm_idx chunk", "", "digest")


def arms(s, d):
    return ndcg(s, d).where("perm_idx < 4").select("qid", (F.col("perm_idx") + 1).alias("arm"), F.col("ndcg").alias("value"))


register(
    "four_arm_decomposition", lambda s, d: c.four_arms(arms(s, d)).withColumn("closure", F.round("closure", 9)),
    "SELECT qid, a2 - a1 AS width, a2 - a3 AS content, a3 - a4 AS presence, a4 - a1 AS scaffold, 0 AS closure, CASE WHEN a2 <> a1 THEN (a2 - a3) / (a2 - a1) END AS content_share FROM (SELECT qid, max(ndcg) FILTER (WHERE perm_idx = 0) AS a1, max(ndcg) FILTER (WHERE perm_idx = 1) AS a2, max(ndcg) FILTER (WHERE perm_idx = 2) AS a3, max(ndcg) FILTER (WHERE perm_idx = 3) AS a4 FROM ndcg GROUP BY qid)",
    "qid", "width content presence scaffold closure",
)
register("score_effects", lambda s, d: c.score_effects(log(s, d), 0, 1), "SELECT a.qid, avg(b.score - a.score) AS effect, avg(abs(b.score - a.score)) AS absolute, count(*) AS n FROM score_log a JOIN score_log b ON a.qid = b.qid AND a.docid = b.docid AND a.perm_idx = 0 AND b.perm_idx = 1 GROUP BY a.qid", "qid n", "effect absolute")
register(
    "histogram_p95", lambda s, d: c.nearest_rank(r.pool(s, d).groupBy("qid").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n")), "size", "n", 0.95),
    "SELECT min(size) AS value FROM (SELECT size, sum(n) OVER (ORDER BY size) AS c, sum(n) OVER () AS t FROM (SELECT size, count(*) AS n FROM (SELECT qid, count(*) AS size FROM pool GROUP BY qid) GROUP BY size)) WHERE c >= ceil(t * 0.95)", "value",
)
register("slots_and_chunks", lambda s, d: c.slots(log(s, d), 6).groupBy("slot", "chunk").agg(F.count("*").alias("n"), F.avg("score").alias("score")), "SELECT position % 6 AS slot, position // 6 AS chunk, count(*) AS n, avg(score) AS score FROM score_log GROUP BY 1, 2", "slot chunk n", "score")
register("variance_fixed_effects", lambda s, d: c.fixed_effects(c.slots(log(s, d), 5)), None, "qid n", "total document slot chunk residual")
register("variance_document_effect", lambda s, d: c.document_effect(log(s, d)), "SELECT qid, var_pop(score) AS total, var_pop(dm) AS document, avg(pow(score - dm, 2)) AS rest FROM (SELECT *, avg(score) OVER (PARTITION BY qid, docid) AS dm FROM score_log) GROUP BY qid", "qid", "total document rest")
register("variance_shares", lambda s, d: c.shares(c.fixed_effects(c.slots(log(s, d), 5)).join(r.qdim(s, d), "qid"), "dataset"), None, "n", "pooled slot_share chunk_share residual_share", "dataset")
RELATIONS["copresence"] = "SELECT qid, count(*) AS n, avg(c) AS offset_mean, var_pop(c) AS residual_variance, CASE WHEN var_pop(wide) > 0 AND var_pop(alone) > 0 THEN corr(wide, alone) END AS corr, sqrt((var_pop(wide) + var_pop(alone)) / 2) AS pooled_sd FROM (SELECT *, wide - alone AS c FROM (SELECT qid, docid, avg(score) FILTER (WHERE perm_idx > 0) AS wide, max(score) FILTER (WHERE perm_idx = 0) AS alone FROM score_log GROUP BY 1, 2)) GROUP BY qid"
register("copresence_summary", lambda s, d: c.copresence(log(s, d)).withColumnRenamed("offset", "offset_mean"), "SELECT * FROM copresence", "qid n", "offset_mean residual_variance corr pooled_sd")
register(
    "copresence_balanced", lambda s, d: c.balanced(c.copresence(log(s, d)).join(r.qdim(s, d), "qid"), "offset"),
    "SELECT sum(w * o) AS mean, sqrt(greatest(0, sum(w * o * o) - sum(w * o) * sum(w * o))) AS sd FROM (SELECT offset_mean AS o, 1.0 / ((SELECT count(DISTINCT dataset) FROM copresence c JOIN qdim q ON q.qid = c.qid) * count(*) OVER (PARTITION BY dataset)) AS w FROM copresence c JOIN qdim q ON q.qid = c.qid)", "", "mean sd",
)
register(
    "response_width_effects", lambda s, d: t.spread(ndcg(s, d)).join(r.qdim(s, d), "qid").groupBy("dataset").agg(F.avg(F.col("greatest") - F.col("mean")).alias("c_obs"), F.avg("delta").alias("v_b"), F.count("*").alias("n")),
    "SELECT dataset, avg(hi - m) AS c_obs, avg(hi - lo) AS v_b, count(*) AS n FROM (SELECT qid, avg(ndcg) AS m, max(ndcg) AS hi, min(ndcg) AS lo FROM ndcg GROUP BY qid) x JOIN qdim q ON q.qid = x.qid GROUP BY dataset", "n", "c_obs v_b", "dataset",
)
register("coverage_assert", lambda s, d: c.coverage(log(s, d)), "SELECT qid, count(DISTINCT perm_idx) AS perms, count(DISTINCT docid) AS docs, count(*) AS n, CASE WHEN count(*) = count(DISTINCT perm_idx) * count(DISTINCT docid) AND max(position) = count(DISTINCT docid) - 1 THEN 1 ELSE 0 END AS complete FROM score_log GROUP BY qid", "qid perms docs n complete")

"""Queries of ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources import relations as r
from .contract import register


def ranking(s, d):
    return r.ranked(r.score_log(s, d))


def canonical(s, d):
    return r.score_log(s, d).where("perm_idx = 0")


register("quality_ndcg_linear", lambda s, d: q.ndcg(ranking(s, d), r.qrels(s, d)), "SELECT qid, perm_idx, ndcg FROM ndcg", "qid perm_idx", "ndcg")
register(
    "quality_trec_measures", lambda s, d: q.trec_measures(ranking(s, d), r.qrels(s, d)),
    """SELECT j.qid, j.perm_idx, CASE WHEN max(i.idcg) > 0 THEN sum(CASE WHEN rnk < 10 THEN rel / log2(rnk + 2) ELSE 0 END) / max(i.idcg) ELSE 0 END AS ndcg_cut,
        CASE WHEN max(n_rel) > 0 THEN sum(CASE WHEN rel > 0 THEN hits / CAST(rnk + 1 AS DOUBLE) ELSE 0 END) / max(n_rel) ELSE 0 END AS map,
        coalesce(1.0 / (min(CASE WHEN rel > 0 THEN rnk END) + 1), 0) AS recip_rank,
        CASE WHEN max(n_rel) > 0 THEN count(*) FILTER (WHERE rel > 0 AND rnk < 10) / CAST(max(n_rel) AS DOUBLE) ELSE 0 END AS recall
    FROM (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, perm_idx ORDER BY rnk) AS hits FROM judged) j JOIN ideal i ON i.qid = j.qid GROUP BY j.qid, j.perm_idx""",
    "qid perm_idx", "ndcg_cut map recip_rank recall",
)
register(
    "quality_first_wins", lambda s, d: q.first_wins(r.table(s, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")),
    "SELECT l_orderkey, count(*) AS n, sum(line) AS lines FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2) GROUP BY 1", "l_orderkey n lines",
)
register(
    "quality_over_queries", lambda s, d: q.over_queries(q.ndcg(ranking(s, d), r.qrels(s, d)).where("perm_idx = 0").withColumn("doubled", F.col("ndcg") * 2), ["ndcg", "doubled"]),
    "SELECT 'ndcg' AS measure, avg(ndcg) AS mean, coalesce(stddev_samp(ndcg), 0) AS std, count(*) AS n FROM ndcg WHERE perm_idx = 0 UNION ALL SELECT 'doubled', avg(2 * ndcg), coalesce(stddev_samp(2 * ndcg), 0), count(*) FROM ndcg WHERE perm_idx = 0",
    "n", "mean std", "measure",
)
XDCG = "SELECT j.qid, j.perm_idx, max(xdcg) AS ideal_x, sum(CASE WHEN rnk < 10 THEN (pow(2, rel) - 1) / log2(rnk + 2) ELSE 0 END) AS x FROM judged j JOIN ideal i ON i.qid = j.qid GROUP BY j.qid, j.perm_idx"
register("quality_ndcg_exponential", lambda s, d: q.ndcg(ranking(s, d), r.qrels(s, d), gain=q.exponential, without="null"), f"SELECT qid, perm_idx, CASE WHEN ideal_x > 0 THEN x / ideal_x END AS ndcg FROM ({XDCG})", "qid perm_idx", "ndcg")
register("quality_ndcg_positive_only", lambda s, d: q.ndcg(ranking(s, d), r.qrels(s, d), gain=q.exponential, without="drop"), f"SELECT qid, perm_idx, x / ideal_x AS ndcg FROM ({XDCG}) WHERE ideal_x > 0", "qid perm_idx", "ndcg")
register(
    "quality_mean_ndcg_by_slot", lambda s, d: q.ndcg(ranking(s, d), r.qrels(s, d), without="drop").groupBy("perm_idx").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n")),
    "SELECT perm_idx, avg(ndcg) AS ndcg, count(*) AS n FROM ndcg n JOIN ideal i ON i.qid = n.qid WHERE i.idcg > 0 GROUP BY perm_idx", "perm_idx n", "ndcg",
)
GOLD = "SELECT q.qid, q.docid, c.fs_rank FROM qrels q LEFT JOIN cand c ON c.qid = q.qid AND c.docid = q.docid WHERE q.rel > 0"
register(
    "quality_first_stage", lambda s, d: q.first_stage(r.cand(s, d), r.qrels(s, d)),
    f"SELECT avg(hit / n) AS macro_recall, sum(hit) / sum(n) AS micro_recall, avg(CASE WHEN hit > 0 THEN 1 ELSE 0 END) AS any_hit, avg(best) AS mean_best_rank, count(*) AS n_queries FROM (SELECT qid, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE fs_rank < 10) AS DOUBLE) AS hit, min(fs_rank) AS best FROM ({GOLD}) GROUP BY qid)",
    "n_queries", "macro_recall micro_recall any_hit mean_best_rank",
)
register("quality_rank_histogram", lambda s, d: q.rank_histogram(r.cand(s, d), r.qrels(s, d)), f"SELECT fs_rank // 10 AS band, count(*) AS n FROM ({GOLD}) GROUP BY 1", "band n")


def three_systems(s, d):
    raw = r.silver_raw(s, d).groupBy(F.col("query_id").alias("qid"), F.col("doc_id").alias("docid")).agg(F.avg("score").alias("score"))
    rels = r.silver_qrels(s, d).select(F.col("query_id").alias("qid"), F.col("doc_id").alias("docid"), "rel")
    rows = raw.join(rels, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    systems = F.explode(F.array(F.struct(F.lit(0).alias("perm_idx"), F.col("score").alias("v")), F.struct(F.lit(1).alias("perm_idx"), (-F.col("docid")).cast("double").alias("v")), F.struct(F.lit(2).alias("perm_idx"), F.col("rel").cast("double").alias("v"))))
    flat = rows.select("qid", "docid", systems.alias("x")).select("qid", "docid", "x.perm_idx", F.col("x.v").alias("score"))
    return q.trec_measures(r.ranked(flat), rels).groupBy("perm_idx").agg(*(F.avg(m).alias(m) for m in ("ndcg_cut", "map", "recip_rank", "recall")))


register(
    "quality_silver_against_oracle", three_systems,
    """SELECT perm_idx, avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) AS ndcg_cut, avg(CASE WHEN n_rel > 0 THEN p / n_rel ELSE 0 END) AS map, avg(coalesce(1.0 / (first + 1), 0)) AS recip_rank, avg(CASE WHEN n_rel > 0 THEN found / CAST(n_rel AS DOUBLE) ELSE 0 END) AS recall FROM (
        SELECT t.perm_idx, t.qid, sum(CASE WHEN rnk < 10 THEN rel / log2(rnk + 2) ELSE 0 END) AS dcg, sum(CASE WHEN rel > 0 THEN hits / CAST(rnk + 1 AS DOUBLE) ELSE 0 END) AS p, min(CASE WHEN rel > 0 THEN rnk END) AS first, count(*) FILTER (WHERE rel > 0 AND rnk < 10) AS found FROM (
            SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, perm_idx ORDER BY rnk) AS hits FROM (
                SELECT *, row_number() OVER (PARTITION BY qid, perm_idx ORDER BY v DESC, docid) - 1 AS rnk FROM (
                    SELECT m.qid, m.docid, coalesce(s.rel, 0) AS rel, g.perm_idx, CASE g.perm_idx WHEN 0 THEN m.score WHEN 1 THEN -m.docid ELSE coalesce(s.rel, 0) END AS v
                    FROM (SELECT query_id AS qid, doc_id AS docid, avg(score) AS score FROM silver_raw GROUP BY 1, 2) m LEFT JOIN silver_qrels s ON s.query_id = m.qid AND s.doc_id = m.docid CROSS JOIN perms g WHERE g.perm_idx < 3))) t GROUP BY 1, 2) x
    JOIN (SELECT query_id AS qid, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) ELSE 0 END) AS idcg, count(*) FILTER (WHERE rel > 0) AS n_rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS i FROM silver_qrels) GROUP BY 1) y ON y.qid = x.qid GROUP BY perm_idx""",
    "perm_idx", "ndcg_cut map recip_rank recall",
)
register(
    "quality_auc", lambda s, d: q.auc(canonical(s, d), r.qrels(s, d)),
    "SELECT a.qid, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 WHEN a.score < b.score THEN 0.0 END) / nullif(count(b.docid), 0) AS auc FROM (SELECT * FROM judged WHERE perm_idx = 0) a LEFT JOIN (SELECT * FROM judged WHERE perm_idx = 0 AND rel = 0) b ON a.qid = b.qid AND a.rel > 0 GROUP BY a.qid",
    "qid", "auc",
)
register(
    "quality_pair_accuracy", lambda s, d: q.pair_accuracy(canonical(s, d), r.qrels(s, d)),
    "SELECT a.qid, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS accuracy FROM judged a JOIN judged b ON a.qid = b.qid AND a.perm_idx = 0 AND b.perm_idx = 0 AND a.rel > b.rel GROUP BY a.qid",
    "qid", "accuracy",
)
register(
    "quality_top_agreement", lambda s, d: q.top_agreement(canonical(s, d), r.qrels(s, d)),
    "SELECT avg(CASE WHEN q.rel = m.best THEN 1 ELSE 0 END) AS agreement, count(*) AS n FROM ranked k JOIN qrels q ON q.qid = k.qid AND q.docid = k.docid JOIN (SELECT qid, max(rel) AS best FROM qrels GROUP BY qid) m ON m.qid = k.qid WHERE k.perm_idx = 0 AND k.rnk = 0",
    "n", "agreement",
)

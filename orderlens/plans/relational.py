"""Queries of joins, filters, set operations, windows and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality as q
from ..operators import relational as c
from ..sources import relations as r
from .contract import register


def log(s, d):
    return r.score_log(s, d)


def ranking(s, d):
    return r.ranked(log(s, d))


def agg(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"))


register("filter_strict_qrels", lambda s, d: agg(c.strict_qrels(r.cand(s, d), r.qrels(s, d).where("rel = 3")), "qid"), "SELECT qid, count(*) AS n FROM cand WHERE qid IN (SELECT qid FROM qrels WHERE rel = 3) GROUP BY qid", "qid n")
register("filter_allowlist", lambda s, d: agg(c.allowlisted(log(s, d), r.qdim(s, d).where("dataset = 'ASIA'"), r.qdim(s, d).where("variant = 'BUILDING'")), "qid"), "SELECT qid, count(*) AS n FROM score_log WHERE qid IN (SELECT qid FROM qdim WHERE dataset = 'ASIA' OR variant = 'BUILDING') GROUP BY qid", "qid n")
register("filter_resume", lambda s, d: c.remaining(r.cand(s, d).select("qid", "docid"), r.pool(s, d).where("fs_rank < 2"), ["qid", "docid"]), "SELECT qid, docid FROM cand WHERE fs_rank >= 2", "qid docid")
register("filter_first_k", lambda s, d: r.pool(s, d, 5).select("qid", "docid", "fs_rank"), "SELECT qid, docid, fs_rank FROM cand WHERE fs_rank < 5", "qid docid fs_rank")
register("filter_label_prefix", lambda s, d: agg(r.table(s, d, "part").where(F.col("p_type").startswith("STANDARD")), "p_type"), "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE 'STANDARD%' GROUP BY 1", "n", "", "p_type")
register("filter_completeness", lambda s, d: agg(c.with_presentations(r.verdict_items(s, d), 6), "qid"), "SELECT qid, count(*) AS n FROM verdict_items GROUP BY qid HAVING count(DISTINCT perm_idx) >= 6", "qid n")
register("filter_retained", lambda s, d: log(s, d).where("score >= 2.0").select("qid", "perm_idx", "docid", "score"), "SELECT qid, perm_idx, docid, score FROM score_log WHERE score >= 2.0", "qid perm_idx docid", "score")
ODD_VALUES = "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 17 = 0 THEN NULL ELSE value END"
register("filter_finite", lambda s, d: c.finite(r.table(s, d, "events").withColumn("value", F.expr(ODD_VALUES)), "value").groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n")), f"SELECT event_type, avg(v) AS v, count(*) AS n FROM (SELECT event_type, {ODD_VALUES} AS v FROM events) WHERE isfinite(v) GROUP BY 1", "n", "v", "event_type")
register("filter_restrict_ranking", lambda s, d: c.restricted(ranking(s, d), r.pool(s, d).where("fs_rank % 2 = 0")).select("qid", "perm_idx", "docid", "rnk", "complete"), "SELECT k.qid, k.perm_idx, k.docid, row_number() OVER (PARTITION BY k.qid, k.perm_idx ORDER BY k.rnk) - 1 AS rnk, 1 AS complete FROM ranked k JOIN pool p ON p.qid = k.qid AND p.docid = k.docid WHERE p.fs_rank % 2 = 0", "qid perm_idx docid rnk complete")
register("filter_results_index", lambda s, d: r.table(s, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 100000) & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 100000 AND o_orderpriority LIKE '1%'", "o_orderkey", "", "o_orderstatus")
register("filter_config_search", lambda s, d: r.table(s, d, "part").where(F.col("p_name").contains("a") & F.col("p_brand").contains("1")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE '%1%'", "p_partkey")
register("filter_error_rows", lambda s, d: c.fully_covered(r.table(s, d, "events"), "user_id", F.col("event_type") == "error", 8), "SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 8 THEN 1 ELSE 0 END AS clean FROM events WHERE event_type <> 'error' GROUP BY 1", "user_id n clean")
register("filter_lower_k_labels", lambda s, d: c.sliced_labels(r.silver_raw(s, d), 1, 2), "SELECT query_id, doc_id, avg(score) AS score, count(*) AS k FROM silver_raw WHERE k IN (1, 2) GROUP BY 1, 2 HAVING count(*) = 2", "doc_id k", "score", "query_id")

register("join_scores_qrels", lambda s, d: q.judged(ranking(s, d).where("perm_idx = 0"), r.qrels(s, d)).select("qid", "docid", "rel", "rnk"), "SELECT qid, docid, rel, rnk FROM judged WHERE perm_idx = 0", "qid docid rel rnk")
register("join_common_queries", lambda s, d: c.common(r.table(s, d, "orders").select(F.col("o_custkey").alias("qid"), "o_orderstatus"), "o_orderstatus", 3), "SELECT o_custkey AS qid FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3", "qid")


def arm(s, d, i):
    return q.ndcg(ranking(s, d), r.qrels(s, d)).where(F.col("perm_idx") == i)


register("join_strict_paired", lambda s, d: c.paired(arm(s, d, 1), arm(s, d, 0), ["qid"], "ndcg"), "SELECT a.qid, a.ndcg - b.ndcg AS difference FROM ndcg a JOIN ndcg b ON a.qid = b.qid AND a.perm_idx = 1 AND b.perm_idx = 0", "qid", "difference")
register("join_unpaired_assert", lambda s, d: c.unpaired(r.table(s, d, "customer").select(F.col("c_custkey").alias("k")), r.table(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]), "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)", "k", "", "side")
register("join_presentation_pairs", lambda s, d: agg(log(s, d).select("qid", "docid", F.col("perm_idx").alias("a")).join(log(s, d).select("qid", "docid", F.col("perm_idx").alias("b")), ["qid", "docid"]).where("a < b"), "qid"), "SELECT qid, count(*) * 45 AS n FROM pool GROUP BY qid", "qid n")
register("join_document_pairs", lambda s, d: ranking(s, d).where("perm_idx = 0").select("qid", F.col("docid").alias("a"), F.col("rnk").alias("x")).join(ranking(s, d).where("perm_idx = 0").select("qid", F.col("docid").alias("b"), F.col("rnk").alias("y")), "qid").where("x < y").groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.col("y") - F.col("x")).alias("distance")), "SELECT a.qid, count(*) AS n, sum(b.rnk - a.rnk) AS distance FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.perm_idx = 0 AND b.perm_idx = 0 AND a.rnk < b.rnk GROUP BY a.qid", "qid n distance")
register("join_ordered_pairs", lambda s, d: agg(c.ordered_pairs(r.pool(s, d)), "qid", "a"), "SELECT a.qid, a.docid AS a, count(*) AS n FROM pool a JOIN pool b ON a.qid = b.qid AND a.docid <> b.docid GROUP BY 1, 2", "qid a n")
register("join_nearest_donors", lambda s, d: c.nearest_donors(r.table(s, d, "documents"), "doc_id", "n_chars", "source").select("doc_id", "gap"), "SELECT a.doc_id, min(abs(a.n_chars - b.n_chars)) AS gap FROM documents a JOIN documents b ON a.source <> b.source GROUP BY 1", "doc_id gap")
register("join_overlay", lambda s, d: c.overlay(r.table(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")), r.table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", ["c_mktsegment"]), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer", "c_custkey", "c_acctbal", "c_mktsegment")
register("join_cohort_coverage", lambda s, d: c.missing(r.table(s, d, "customer").select(F.col("c_custkey").alias("qid")), r.cand(s, d), ["qid"]), "SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "qid")
register("join_shard_merge", lambda s, d: c.shard_check(r.table(s, d, "events").withColumn("shard", F.col("event_id") % 4), "shard", "event_id"), "SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_n, count(*) - count(DISTINCT event_id) AS repeated, CASE WHEN min(event_id) = 0 AND max(event_id) = count(DISTINCT event_id) - 1 THEN 1 ELSE 0 END AS complete FROM events", "n distinct_n repeated complete")
register("join_positions", lambda s, d: log(s, d).where("perm_idx = 2").select("qid", "docid", "position", (F.col("position") % 4).alias("slot"), F.floor(F.col("position") / 4).alias("chunk")), "SELECT qid, docid, position, position % 4 AS slot, position // 4 AS chunk FROM score_log WHERE perm_idx = 2", "qid docid position slot chunk")
register("join_catalog_binding", lambda s, d: r.table(s, d, "nation").join(r.table(s, d, "supplier").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("latest")), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.coalesce("latest", F.lit(-1)).alias("run")), "SELECT n_nationkey, coalesce(max(s_suppkey), -1) AS run FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", "n_nationkey run")

N = "(SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM pool)"


def sized(s, d):
    return r.pool(s, d).withColumn("n", F.count("*").over(Window.partitionBy("qid")))


register("window_zero_based_rank", lambda s, d: ranking(s, d).select("qid", "perm_idx", "docid", "rnk"), "SELECT qid, perm_idx, docid, rnk FROM ranked", "qid perm_idx docid rnk")
register("window_adjacent_margin", lambda s, d: log(s, d).select("qid", "perm_idx", "docid", (F.col("score") - F.lead("score").over(Window.partitionBy("qid", "perm_idx").orderBy(F.desc("score"), "docid"))).alias("margin")).where("margin is not null"), "SELECT * FROM (SELECT qid, perm_idx, docid, score - lead(score) OVER (PARTITION BY qid, perm_idx ORDER BY score DESC, docid) AS margin FROM score_log) WHERE margin IS NOT NULL", "qid perm_idx docid", "margin")
register("window_average_rank", lambda s, d: r.silver_raw(s, d).where("k = 0").select("query_id", "doc_id", (F.rank().over(Window.partitionBy("query_id").orderBy("score")) + (F.count("*").over(Window.partitionBy("query_id", "score")) - 1) / 2).alias("r")), "SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS r FROM silver_raw WHERE k = 0", "doc_id", "r", "query_id")
register("window_position_thirds", lambda s, d: agg(sized(s, d).select("qid", F.when(F.col("fs_rank") < F.col("n") / 3, "top").when(F.col("fs_rank") < 2 * F.col("n") / 3, "middle").otherwise("bottom").alias("bucket")), "qid", "bucket"), f"SELECT qid, CASE WHEN fs_rank < n / 3.0 THEN 'top' WHEN fs_rank < 2 * n / 3.0 THEN 'middle' ELSE 'bottom' END AS bucket, count(*) AS n FROM {N} GROUP BY 1, 2", "qid n", "", "bucket")
register("window_chunks_contiguous", lambda s, d: sized(s, d).select("qid", "docid", c.chunked(None, "n", 5, False).alias("chunk")), "SELECT qid, docid, fs_rank // 5 AS chunk FROM pool", "qid docid chunk")
register("window_chunks_round_robin", lambda s, d: sized(s, d).select("qid", "docid", c.chunked(None, "n", 5, True).alias("chunk")), f"SELECT qid, docid, fs_rank % CAST(ceil(n / 5.0) AS BIGINT) AS chunk FROM {N}", "qid docid chunk")
register("window_sliding_lists", lambda s, d: r.pool(s, d).groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.explode(c.sliding_windows(F.col("n"), 6, 4)).alias("start")), "SELECT DISTINCT qid, greatest(0, CASE WHEN n > 6 AND i <= (n - 6) // 4 THEN n - 6 - i * 4 ELSE 0 END) AS start FROM (SELECT qid, count(*) AS n FROM pool GROUP BY qid), (SELECT range AS i FROM range(6))", "qid start")
register("window_blocks", lambda s, d: agg(r.cand(s, d).select("qid", F.floor(F.col("fs_rank") / 7).alias("block")), "qid", "block"), "SELECT qid, fs_rank // 7 AS block, count(*) AS n FROM cand GROUP BY 1, 2", "qid block n")
register("window_stratified_sample", lambda s, d: c.stratified(r.cand(s, d), 2, 6, 2, 1).select("qid", "docid", "band"), "SELECT qid, docid, band FROM (SELECT *, row_number() OVER (PARTITION BY qid, band ORDER BY md5(concat(qid, ':', docid))) AS i FROM (SELECT *, CASE WHEN fs_rank < 2 THEN 0 WHEN fs_rank < 6 THEN 1 ELSE 2 END AS band FROM cand)) WHERE band = 0 OR (band = 1 AND i <= 2) OR (band = 2 AND i <= 1)", "qid docid band")
register("window_round_robin_shards", lambda s, d: agg(r.cand(s, d).select((F.col("fs_rank") % 3).alias("shard")), "shard"), "SELECT fs_rank % 3 AS shard, count(*) AS n FROM cand GROUP BY 1", "shard n")
register("window_running_best", lambda s, d: r.table(s, d, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("best")), "SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best FROM orders", "o_custkey o_orderkey", "best")
register("window_warmup", lambda s, d: r.cand(s, d).select("qid", "docid", c.warmup(F.col("fs_rank"), 8, 3.0).alias("lam")), "SELECT qid, docid, least(3.0, 3.0 * fs_rank / 8) AS lam FROM cand", "qid docid", "lam")
register("window_quantile_map", lambda s, d: c.quantile_map(log(s, d).where("perm_idx = 0").drop("perm_idx"), log(s, d).where("perm_idx = 1").drop("perm_idx"), "qid", "score").select("qid", "docid", "mapped"), "SELECT a.qid, a.docid, b.score AS mapped FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, docid) AS i FROM score_log WHERE perm_idx = 0) a JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, docid) AS i FROM score_log WHERE perm_idx = 1) b ON a.qid = b.qid AND a.i = b.i", "qid docid", "mapped")

register("sort_top_k", lambda s, d: ranking(s, d).where("rnk < 4").select("qid", "perm_idx", "docid"), "SELECT qid, perm_idx, docid FROM ranked WHERE rnk < 4", "qid perm_idx docid")
register("sort_strongest_positive", lambda s, d: c.strongest_positive(r.pool(s, d), r.qrels(s, d)).select("qid", "docid", "rel"), "SELECT qid, docid, rel FROM (SELECT q.qid, q.docid, q.rel, row_number() OVER (PARTITION BY q.qid ORDER BY q.rel DESC, q.docid) AS i FROM qrels q JOIN pool p ON p.qid = q.qid AND p.docid = q.docid WHERE q.rel > 0) WHERE i = 1", "qid docid rel")
register("sort_prefix_sample", lambda s, d: r.table(s, d, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("h")).orderBy("h", "c_custkey").limit(25).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 25", "c_custkey")
register("sort_inverse_permutation", lambda s, d: c.inverse(ranking(s, d)), "SELECT qid, perm_idx, rnk, position FROM ranked", "qid perm_idx rnk position")

register("set_union", lambda s, d: r.table(s, d, "orders").select(F.col("o_custkey").alias("k")).union(r.table(s, d, "customer").select("c_custkey")).distinct(), "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer", "k")
register("set_intersection", lambda s, d: r.table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(r.table(s, d, "supplier").select("s_suppkey")), "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier", "k")
register("set_difference", lambda s, d: r.table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(r.table(s, d, "orders").select("o_custkey")), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", "k")
register("set_train_held_split", lambda s, d: c.split_by_rank(r.cand(s, d), "qid", 30), "SELECT qid, CASE WHEN row_number() OVER (ORDER BY h DESC, qid) <= 30 THEN 1 ELSE 0 END AS held FROM (SELECT DISTINCT qid, md5(CAST(qid AS VARCHAR)) AS h FROM cand)", "qid held")
register("set_label_pool_subset", lambda s, d: agg(r.silver_raw(s, d).join(r.silver_qrels(s, d).where("rel > 0").select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi"), "query_id"), "SELECT query_id, count(*) AS n FROM silver_raw s WHERE EXISTS (SELECT 1 FROM silver_qrels q WHERE q.query_id = s.query_id AND q.doc_id = s.doc_id AND rel > 0) GROUP BY 1", "n", "", "query_id")
register("set_derangement", lambda s, d: c.derangement(r.pool(s, d)), "SELECT qid, docid, coalesce(lead(docid) OVER (PARTITION BY qid ORDER BY docid), first_value(docid) OVER (PARTITION BY qid ORDER BY docid)) AS other FROM pool", "qid docid other")
register("set_alias_dedup", lambda s, d: r.table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])), ",").alias("aliases")), "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS aliases FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1", "user_id", "", "aliases")

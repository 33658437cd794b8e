"""Queries of downstream consumers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import consumers as c
from ..operators import quality as q
from ..operators import stability as t
from ..sources import relations as r
from .contract import RELATIONS, register

#: Words that are articles are dropped as words: this SQL's word boundaries know only ASCII.
NORMAL = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
RELATIONS["answers"] = f"SELECT qid, perm_idx, {NORMAL.format('prediction')} AS p, {NORMAL.format('gold')} AS g FROM reader_items"
RELATIONS["answer_words"] = "SELECT qid, perm_idx, p, g, list_filter(string_split(p, ' '), lambda w: w <> '') AS pw, list_filter(string_split(g, ' '), lambda w: w <> '') AS gw FROM answers"
RELATIONS["answer_scored"] = """SELECT qid, perm_idx, p, CASE WHEN p = g THEN 1.0 ELSE 0.0 END AS em,
    CASE WHEN len(pw) = 0 OR len(gw) = 0 THEN (CASE WHEN p = g THEN 1.0 ELSE 0.0 END) WHEN (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) AND p <> g THEN 0.0
    ELSE 2.0 * list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda v: v = w)), len(list_filter(gw, lambda v: v = w))))) / (len(pw) + len(gw)) END AS f1 FROM answer_words"""
FLIPS = "SELECT qid, arg_min(v, (-n, first)) AS answer, max(n) AS votes, sum(n) AS total FROM (SELECT qid, v, count(*) AS n, min(perm_idx) AS first FROM ({}) GROUP BY 1, 2) GROUP BY 1"
RELATIONS["answer_votes"] = "SELECT qid, max(n) AS votes, sum(n) AS n, max_by(v, struct_pack(a := n, b := -first)) AS answer FROM (SELECT qid, p AS v, count(*) AS n, min(perm_idx) AS first FROM answers GROUP BY 1, 2) GROUP BY qid"


def items(s, d):
    return r.reader_items(s, d)


register("answer_normalization", lambda s, d: items(s, d).select("qid", "perm_idx", x.normalized_answer(F.col("prediction")).alias("p")), "SELECT qid, perm_idx, p FROM answers", "qid perm_idx", "", "p")
register("answer_em_f1", lambda s, d: c.answer_scores(items(s, d)), "SELECT * FROM answer_scored", "qid perm_idx", "em f1")
register("answer_over_golds", lambda s, d: c.over_golds(c.answer_scores(items(s, d)), "qid"), "SELECT qid, max(em) AS em, max(f1) AS f1 FROM answer_scored GROUP BY qid", "qid", "em f1")
register("answer_majority", lambda s, d: c.majority(items(s, d), x.normalized_answer(F.col("prediction"))), "SELECT qid, answer, votes, n, 1 - votes / CAST(n AS DOUBLE) AS flip FROM answer_votes", "qid votes n", "flip", "answer")
RELATIONS["reader_rows"] = "SELECT s.qid, count(*) AS n, avg(em) AS em, avg(f1) AS f1, max(em) - min(em) AS em_spread, max(f1) - min(f1) AS f1_spread, min_by(em, perm_idx) AS canonical_em, min_by(f1, perm_idx) AS canonical_f1, max(1 - v.votes / CAST(v.n AS DOUBLE)) AS flip FROM answer_scored s JOIN answer_votes v ON v.qid = s.qid GROUP BY s.qid"
READER = "em f1 em_spread f1_spread canonical_em canonical_f1 flip"
register("reader_per_query", lambda s, d: c.reader_per_query(items(s, d)), "SELECT * FROM reader_rows", "qid n", READER)
register("reader_corpus", lambda s, d: q.over_queries(c.reader_per_query(items(s, d)), READER.split()), " UNION ALL ".join(f"SELECT '{m}' AS measure, avg({m}) AS mean, coalesce(stddev_samp({m}), 0) AS std, count({m}) AS n FROM reader_rows" for m in READER.split()), "n", "mean std", "measure")


def verdicts(s, d):
    return r.verdict_items(s, d)


def gold():
    return F.when(F.col("qid") % 3 == 0, "SUPPORTED").when(F.col("qid") % 3 == 1, "REFUTED").otherwise("NEI")


RELATIONS["verdict_rows"] = """SELECT v.qid, avg(ok) AS accuracy, max(ok) - min(ok) AS accuracy_spread, avg(CASE WHEN prediction IS NULL THEN 1.0 ELSE 0.0 END) AS invalid, max(m.votes) AS votes, max(m.n) AS n, max(1 - m.votes / CAST(m.n AS DOUBLE)) AS flip
    FROM (SELECT *, CASE WHEN prediction = (CASE qid % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED' ELSE 'NEI' END) THEN 1.0 ELSE 0.0 END AS ok FROM verdict_items) v JOIN (SELECT qid, max(n) AS votes, sum(n) AS n FROM (SELECT qid, coalesce(prediction, '<INVALID>') AS v, count(*) AS n FROM verdict_items GROUP BY 1, 2) GROUP BY 1) m ON m.qid = v.qid GROUP BY v.qid"""
register(
    "verdict_normalization", lambda s, d: r.table(s, d, "events").select("event_id", x.collapsed(F.col("event_type")).alias("t")).select("event_id", c.verdict(F.when(F.col("t") == "view", "It is supported.").when(F.col("t") == "click", "supported or refuted").otherwise("FALSE")).alias("v")),
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'SUPPORTED' WHEN 'click' THEN NULL ELSE 'REFUTED' END AS v FROM events", "event_id", "", "v",
)
register("verdict_per_query", lambda s, d: c.verdict_per_query(verdicts(s, d), gold()), "SELECT * FROM verdict_rows", "qid votes n", "accuracy accuracy_spread invalid flip")
register("verdict_corpus", lambda s, d: q.over_queries(c.verdict_per_query(verdicts(s, d), gold()), ["accuracy", "accuracy_spread", "invalid", "flip"]), " UNION ALL ".join(f"SELECT '{m}' AS measure, avg({m}) AS mean, coalesce(stddev_samp({m}), 0) AS std, count({m}) AS n FROM verdict_rows" for m in ("accuracy", "accuracy_spread", "invalid", "flip")), "n", "mean std", "measure")
register("verdict_label_counts", lambda s, d: c.label_counts(verdicts(s, d)), "SELECT coalesce(prediction, '<INVALID>') AS label, count(*) AS n FROM verdict_items GROUP BY 1", "n", "", "label")


def ranking(s, d):
    return r.ranked(r.score_log(s, d))


def flip_sql(v: str) -> str:
    return f"(SELECT qid, 1 - max(n) / CAST(sum(n) AS DOUBLE) AS f FROM (SELECT qid, {v} AS v, count(*) AS n FROM ends GROUP BY 1, 2) GROUP BY qid)"


RELATIONS["ends"] = "SELECT e.*, q.rel AS quality FROM (SELECT qid, perm_idx, min_by(docid, rnk) AS pick, max_by(docid, rnk) AS worst FROM ranked GROUP BY 1, 2) e LEFT JOIN qrels q ON q.qid = e.qid AND q.docid = e.pick"
register(
    "selection_metrics", lambda s, d: c.selections(ranking(s, d), r.qrels(s, d)),
    f"SELECT a.qid, a.quality, x.score_range, p.f AS pick_flip, k.f AS quality_flip, w.f AS pair_flip FROM (SELECT qid, avg(quality) AS quality FROM ends GROUP BY qid) a JOIN {flip_sql('pick')} p ON p.qid = a.qid JOIN {flip_sql('quality')} k ON k.qid = a.qid JOIN {flip_sql('concat(pick, 0, worst)')} w ON w.qid = a.qid JOIN (SELECT qid, max(m) - min(m) AS score_range FROM (SELECT qid, docid, avg(score) AS m FROM score_log GROUP BY 1, 2) GROUP BY qid) x ON x.qid = a.qid",
    "qid", "quality pick_flip quality_flip pair_flip score_range",
)
register("reader_gold_in_top", lambda s, d: c.gold_in_top(ranking(s, d), r.qrels(s, d), 5).fillna(-1, ["gold_slot"]), "SELECT qid, perm_idx, coalesce(min(CASE WHEN rel > 0 THEN rnk END), -1) AS gold_slot, count(*) FILTER (WHERE rel > 0) AS n_gold FROM judged WHERE rnk < 5 GROUP BY 1, 2", "qid perm_idx gold_slot n_gold")
register("ranked_top_k", lambda s, d: r.ranked(r.score_log(s, d), "position", "docid").where("rnk < 3"), "SELECT qid, perm_idx, docid, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid, perm_idx ORDER BY score DESC, position, docid) - 1 AS rnk FROM score_log) WHERE rnk < 3", "qid perm_idx docid rnk")
register("math_answer_number", lambda s, d: r.table(s, d, "documents").select("doc_id", x.last_number(F.col("text")).alias("v")), r"SELECT doc_id, CASE WHEN len(m) > 0 THEN m[len(m)] END AS v FROM (SELECT doc_id, regexp_extract_all(text, '-?\d+(?:\.\d+)?') AS m FROM documents)", "doc_id", "", "v")


def per_query(s, d):
    order = ranking(s, d)
    taus = t.mean_tau(order).select("qid", t.tau_psi(F.col("tau")).alias("tau_psi"))
    return q.ndcg(order, r.qrels(s, d)).groupBy("qid").agg(F.avg("ndcg").alias("ndcg")).join(taus, "qid", "left").join(r.qdim(s, d), "qid")


RELATIONS["cell_rows"] = "SELECT d.*, n.ndcg, p.tau_psi FROM (SELECT qid, avg(ndcg) AS ndcg FROM ndcg GROUP BY qid) n JOIN qdim d ON d.qid = n.qid LEFT JOIN psi p ON p.qid = n.qid"
RELATIONS["cells"] = "SELECT dataset, variant, avg(ndcg) AS ndcg, avg(tau_psi) AS tau_psi FROM cell_rows GROUP BY 1, 2"


def cells(s, d):
    return per_query(s, d).groupBy("dataset", "variant").agg(F.avg("ndcg").alias("ndcg"), F.avg("tau_psi").alias("tau_psi"))


register("seed_macro_average", lambda s, d: c.macro(per_query(s, d), "ndcg"), "SELECT variant, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n_seeds FROM (SELECT variant, training_seed, avg(v) AS v FROM (SELECT variant, training_seed, dataset, avg(ndcg) AS v FROM cell_rows GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1", "n_seeds", "mean sd", "variant")
register("grid_winner_counts", lambda s, d: c.winners(cells(s, d), "ndcg"), "SELECT variant, count(*) FILTER (WHERE r = 1) AS wins FROM (SELECT variant, rank() OVER (PARTITION BY dataset ORDER BY round(ndcg, 12) DESC) AS r FROM cells) GROUP BY variant", "wins", "", "variant")
register("metric_discordance", lambda s, d: c.discordance(cells(s, d), "ndcg", "tau_psi"), "SELECT dataset, a AS best_quality, b AS best_stability, CASE WHEN a <> b THEN 1 ELSE 0 END AS differ FROM (SELECT dataset, first(variant ORDER BY round(ndcg, 12) DESC, variant) AS a, first(variant ORDER BY round(tau_psi, 12), variant) AS b FROM cells GROUP BY dataset)", "differ", "", "dataset best_quality best_stability")
register(
    "round_robin_delta", lambda s, d: c.paired_deltas(q.ndcg(ranking(s, d), r.qrels(s, d)).where("perm_idx < 2").join(r.qdim(s, d), "qid").select("dataset", F.col("perm_idx").alias("arm"), F.col("ndcg").alias("value")), 0, 1),
    "SELECT dataset, delta, max(abs(delta)) OVER () AS most FROM (SELECT dataset, avg(ndcg) FILTER (WHERE perm_idx = 1) - avg(ndcg) FILTER (WHERE perm_idx = 0) AS delta FROM ndcg n JOIN qdim q ON q.qid = n.qid GROUP BY dataset)", "", "delta most", "dataset",
)


def runs(s, d):
    name = F.concat(F.element_at(F.array(F.lit("qwen3-4b-sft"), F.lit("granite-8b-avg"), F.lit("gemma4-12b")), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit("-k"), (F.col("c_custkey") % 11).cast("string"))
    return r.table(s, d, "customer").select(F.col("c_custkey").alias("id"), *(v.alias(k) for k, v in c.parsed_run(name).items()))


register(
    "run_id_classifier", runs,
    "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'qwen3' WHEN 1 THEN 'granite' ELSE 'gemma4' END AS family, CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 12 END AS size, CASE c_custkey % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'averaged' ELSE 'base' END AS recipe, c_custkey % 11 AS k FROM customer", "id k", "size", "family recipe",
)
register("scaling_audit_dedup", lambda s, d: c.latest(r.table(s, d, "orders"), ["o_custkey", "o_orderpriority"], F.desc("o_totalprice"), F.col("o_orderkey")), "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1", "o_custkey o_orderkey", "", "o_orderpriority")


def index(s, d):
    old = r.table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("v"), F.lit(0).alias("age"))
    new = r.table(s, d, "orders").where("o_orderkey % 2 = 1").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("v"), F.lit(1).alias("age"))
    return c.latest(old.unionByName(new), ["o_custkey", "o_orderstatus"], F.desc("age"), F.desc("v"))


register("results_index_upsert", index, "SELECT o_custkey, o_orderstatus, v, age FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY age DESC, v DESC) AS i FROM (SELECT o_custkey, o_orderstatus, o_totalprice AS v, o_orderkey % 2 AS age FROM orders)) WHERE i = 1", "o_custkey age", "v", "o_orderstatus")
register("results_index_counts", lambda s, d: index(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n")), "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", "n", "", "o_orderstatus")

"""Queries of sources, scalar functions, generators, scorers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import generators as g
from ..operators import scorers
from ..sources import formats as f
from ..sources import relations as r
from ..sources.scratch import scratch
from ..streaming import labels as st
from .contract import register


def log(s, d):
    return r.score_log(s, d)


def ranking(s, d):
    return r.ranked(log(s, d))


# sources and sinks
def qrels_file(s, d):
    path = scratch(s, "qrels")
    q = r.qrels(s, d)
    lines = q.select(F.concat_ws(" ", "qid", F.lit("0"), "docid", "rel").alias("value"))
    lines.unionByName(s.createDataFrame([("short line",), ("a 0 b x",)], "value string")).write.text(path)
    return path


register("source_qrels", lambda s, d: f.read_qrels(s, qrels_file(s, d)), "SELECT CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, rel FROM qrels", "rel", "", "qid docid")
register("source_judged_queries", lambda s, d: f.judged_queries(s, qrels_file(s, d)).where("qid <> 'a'"), "SELECT DISTINCT CAST(qid AS VARCHAR) AS qid FROM qrels", "", "", "qid")


def run_file(s, d):
    path = scratch(s, "run")
    f.write_run(ranking(s, d).where("perm_idx = 0"), path, "ours")
    return path


def run_rows(s, d):
    return f.read_run(s, run_file(s, d))


register("source_run_round_trip", lambda s, d: run_rows(s, d).where("not bad").select("qid", "docid", "rank", "tag"), "SELECT CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, rnk + 1 AS rank, 'ours' AS tag FROM ranked WHERE perm_idx = 0", "rank", "", "qid docid tag")
register("source_run_sorted", lambda s, d: f.sorted_run(run_rows(s, d)).select("qid", "rank", F.monotonically_increasing_id().alias("at")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank"))), lambda x: x["rank"].cast("string")), " ").alias("ranks"), (F.max("at") - F.min("at") + 1).alias("together")), "SELECT CAST(qid AS VARCHAR) AS qid, string_agg(CAST(rnk + 1 AS VARCHAR), ' ' ORDER BY rnk) AS ranks, count(*) AS together FROM ranked WHERE perm_idx = 0 GROUP BY qid", "together", "", "qid ranks")
register("source_run_import", lambda s, d: f.retagged(run_rows(s, d), "baseline").groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("queries")), "SELECT 'baseline' AS tag, count(*) AS n, count(DISTINCT qid) AS queries FROM pool", "n queries", "", "tag")


def topics(s, d):
    path = scratch(s, "topics")
    r.table(s, d, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value")).write.text(path)
    return f.read_topics(s, path)


register("source_topics", topics, "SELECT CAST(c_custkey AS VARCHAR) AS qid, c_name AS text FROM customer", "", "", "qid text")


def passages(s, d):
    p = r.table(s, d, "part").select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("text"))
    return r.pool(s, d).select(F.col("qid").cast("string").alias("qid"), F.concat(F.lit("query "), F.col("qid")).alias("query"), F.col("fs_rank").cast("int").alias("rank"), F.col("docid").cast("string").alias("pid"), (F.col("docid") % 100 + 1).alias("_j")).join(p, F.col("_j") == F.col("_k")).drop("_j", "_k")


def fixture(s, d):
    path = scratch(s, "fixture")
    f.fixture_of(passages(s, d)).write.json(path)
    return f.read_fixture(s, path)


FIXTURE = "SELECT CAST(qid AS VARCHAR) AS qid, concat('query ', qid) AS query, fs_rank AS rank, CAST(docid AS VARCHAR) AS pid, p_name AS text FROM pool JOIN part ON p_partkey = docid % 100 + 1"
register("source_fixture_jsonl", fixture, FIXTURE, "rank", "", "qid query pid text")
register("source_fixture_pids", lambda s, d: fixture(s, d).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pid"))), lambda p: p["pid"]), " ").alias("pids")), f"SELECT qid, string_agg(pid, ' ' ORDER BY rank) AS pids FROM ({FIXTURE}) GROUP BY qid", "", "", "qid pids")
register("source_indexed_text", lambda s, d: f.with_text(r.pool(s, d).select("qid", (F.col("docid") % 50 + 1).alias("docid")), r.table(s, d, "part"), "p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")), F.concat_ws(" ", "p_brand", "p_type")), "SELECT qid, docid % 50 + 1 AS docid, CASE WHEN p_size > 25 THEN p_name ELSE concat_ws(' ', p_brand, p_type) END AS text FROM pool JOIN part ON p_partkey = docid % 50 + 1", "qid docid", "", "text")


def stored_log(s, d):
    path = scratch(s, "score-log")
    rows = log(s, d).select(F.lit("base").alias("checkpoint"), F.lit("k10").alias("recipe"), F.col("qid").alias("query_id"), "perm_idx", F.col("docid").alias("doc_id"), "position", "score", F.lit("random").alias("permutation_label"), F.lit(42).alias("seed"))
    f.write_score_log(rows, path, "checkpoint")
    return f.read_score_log(s, path)


register("source_score_log", lambda s, d: stored_log(s, d).groupBy("query_id", "checkpoint").agg(F.count("*").alias("n"), F.sum("score").alias("total")), "SELECT qid AS query_id, 'base' AS checkpoint, count(*) AS n, sum(score) AS total FROM score_log GROUP BY qid", "query_id n", "total", "checkpoint")
register("source_aligned_scores", lambda s, d: f.aligned([log(s, d).where("false"), log(s, d).where("not (perm_idx = 3 and docid % 2 = 0)")]).select("qid", "docid", F.size("scores").alias("k"), F.aggregate("scores", F.lit(0.0), lambda a, v: a + v).alias("total")), "SELECT s.qid, s.docid, count(*) AS k, sum(s.score) AS total FROM score_log s WHERE s.perm_idx <> 3 OR s.qid IN (SELECT qid FROM pool GROUP BY qid HAVING bool_and(docid % 2 = 0) OR bool_and(docid % 2 = 1)) AND docid % 2 = 1 GROUP BY 1, 2", "qid docid k", "total")


def silver(s, d):
    path = scratch(s, "silver")
    per = r.silver_raw(s, d).groupBy("query_id", F.col("doc_id").cast("string").alias("doc_id")).agg(F.avg("score").alias("score_continuous"), F.transform(F.array_sort(F.collect_list(F.struct("k", "score"))), lambda v: v["score"]).alias("score_raw_vector"))
    rows = per.select("query_id", "doc_id", "score_continuous", "score_raw_vector", F.lit(None).cast("array<double>").alias("score_grade_vector"), F.size("score_raw_vector").alias("k_perms"), F.lit("teacher").alias("teacher"), F.lit("2000-01-01T00:00:00Z").alias("created_at"), F.create_map(F.lit("from"), F.lit("raw")).alias("extra"))
    f.append_silver(rows.where("query_id < 'src3'"), path)
    f.append_silver(rows.where("query_id >= 'src3'"), path)
    return f.read_silver(s, path)


register("source_silver_jsonl", lambda s, d: silver(s, d).select("query_id", "doc_id", "score_continuous", "k_perms", F.col("score_raw_vector")[2].alias("third"), F.col("extra")["from"].alias("origin")), "SELECT query_id, CAST(doc_id AS VARCHAR) AS doc_id, avg(score) AS score_continuous, count(*) AS k_perms, max(score) FILTER (WHERE k = 2) AS third, 'raw' AS origin FROM silver_raw GROUP BY 1, 2", "k_perms", "score_continuous third", "query_id doc_id origin")
register("source_regrouped_check", lambda s, d: f.regrouped(r.table(s, d, "events"), "event_type", "event_id"), "SELECT event_type, count(*) AS n_groups FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type GROUP BY 1 HAVING count(*) > 1", "n_groups", "", "event_type")
register("source_first_seen_order", lambda s, d: f.first_seen(r.table(s, d, "events"), "user_id", "event_id"), "SELECT user_id, min(event_id) AS place FROM events GROUP BY 1", "user_id place")
register("source_duplicate_ids", lambda s, d: f.unique_ids(r.table(s, d, "lineitem"), "l_orderkey"), "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", "l_orderkey n")
register("source_shard_concat", lambda s, d: f.union_shards([r.table(s, d, "events").where(F.col("event_id") % 3 == i) for i in range(3)]).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1", "n", "", "event_type")


def topped(s, d):
    c = r.table(s, d, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.count("*").alias("n"))
    l = r.table(s, d, "events").groupBy(F.col("user_id").alias("qid")).agg(F.count("*").alias("n"))
    return f.topped_up(c.withColumn("origin", F.lit("parent")), l.withColumn("origin", F.lit("topup")), "qid", "n")


register("source_psi_topup", topped, "SELECT coalesce(p.qid, e.qid) AS qid, CASE WHEN p.n >= coalesce(e.n, -1) THEN p.n ELSE coalesce(e.n, p.n) END AS n, CASE WHEN p.n >= coalesce(e.n, -1) THEN 'parent' WHEN e.n IS NULL THEN 'parent' ELSE 'topup' END AS origin FROM (SELECT o_custkey AS qid, count(*) AS n FROM orders GROUP BY 1) p FULL JOIN (SELECT user_id AS qid, count(*) AS n FROM events GROUP BY 1) e ON p.qid = e.qid", "qid n", "", "origin")
register("source_latest_artifact", lambda s, d: f.latest_complete(r.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F"), "SELECT o_custkey, max(o_orderkey) AS o_orderkey, 'F' AS o_orderstatus FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", "o_custkey o_orderkey", "", "o_orderstatus")


def training_events(s, d):
    e = r.table(s, d, "events").select(F.to_json(F.struct(F.when(F.col("event_type") == "click", "eval").otherwise("train").alias("event"), F.col("event_id").alias("step"), F.col("value").alias("metric"))).alias("value"))
    return f.progress_events(e)


register("source_training_progress", training_events, "SELECT event_id AS step, value AS metric FROM events WHERE event_type = 'click'", "step", "metric", digits=6)
register("source_dense_first_stage", lambda s, d: f.dense_top_k(r.table(s, d, "embeddings").where("vec_id % 50 = 0"), r.table(s, d, "embeddings"), "vec_id", "embedding", 10).select("qid", "docid", "rank"), "SELECT * FROM (SELECT q.vec_id AS qid, d.vec_id AS docid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) DESC, d.vec_id) AS rank FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0) WHERE rank <= 10", "qid docid rank")
register("source_bm25_first_stage", lambda s, d: f.bm25(r.table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), r.table(s, d, "documents"), "doc_id", "text", 10), None, "qid docid rank", "score")

# scalar functions
DOCS = "documents"


def docs(s, d):
    return r.table(s, d, DOCS)


register("function_normalize_truncate", lambda s, d: docs(s, d).select("doc_id", x.collapsed(F.col("text"), 80).alias("t")), r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) AS t FROM documents", "doc_id", "", "t")
register("function_first_words", lambda s, d: docs(s, d).select("doc_id", x.rounded_brackets(F.concat(F.lit("[7] "), x.first_words(F.col("text"), 6))).alias("t")), r"SELECT doc_id, concat('(7) ', array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 6), ' ')) AS t FROM documents", "doc_id", "", "t")
register("function_permutation_parse", lambda s, d: r.table(s, d, "customer").select("c_custkey", F.array_join(x.permutation(F.concat(F.lit("["), (F.col("c_custkey") % 7 + 1).cast("string"), F.lit("] > ["), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("] > [9]")), 5), ",").alias("p")), "SELECT c_custkey, array_to_string(list_concat(said, list_filter([0, 1, 2, 3, 4], lambda i: NOT list_contains(said, i))), ',') AS p FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 4 THEN [c_custkey % 3] WHEN c_custkey % 7 = c_custkey % 3 THEN [c_custkey % 3] ELSE [c_custkey % 7, c_custkey % 3] END AS said FROM customer)", "c_custkey", "", "p")
register("function_grade_parse", lambda s, d: r.table(s, d, "orders").select("o_orderkey", x.grade(F.concat(F.lit("Grade: "), (F.col("o_orderkey") % 5).cast("string"))).alias("g"), x.fraction(F.concat(F.lit("score 0."), (F.col("o_orderkey") % 10).cast("string"))).alias("f")).fillna(-1, ["g"]), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 ELSE -1 END AS g, (o_orderkey % 10) / 10.0 AS f FROM orders", "o_orderkey g", "f")
register("function_score_lines", lambda s, d: r.table(s, d, "part").select("p_partkey", x.score_lines(F.concat(F.lit("[1]: "), F.col("p_size").cast("string"), F.lit(" and [2] = 2.5"))).alias("m")).select("p_partkey", F.col("m")[1].alias("one"), F.col("m")[2].alias("two")), "SELECT p_partkey, p_size AS one, 2.5 AS two FROM part", "p_partkey", "one two")
register("function_grade_from_cuts", lambda s, d: r.table(s, d, "orders").select("o_orderkey", x.grade_of(F.col("o_totalprice"), [50000.0, 150000.0, 300000.0]).alias("g")), "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 150000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END AS g FROM orders", "o_orderkey g")
register("function_slug", lambda s, d: r.table(s, d, "part").select("p_partkey", x.slug(F.concat(F.lit("  "), "p_name", F.lit(" / X!"))).alias("t"), x.path_restored(x.path_safe(F.concat(F.lit("a/"), "p_brand"))).alias("b")), r"SELECT p_partkey, regexp_replace(regexp_replace(lower(concat('  ', p_name, ' / X!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS t, concat('a/', p_brand) AS b FROM part", "p_partkey", "", "t b")
register("function_stable_seed", lambda s, d: r.table(s, d, "customer").select("c_custkey", x.stable_seed(F.col("c_name"), F.lit("7")).cast("string").alias("seed")), "SELECT c_custkey, CAST(CAST(concat('0x', substr(sha256(concat(c_name, chr(0), '7')), 1, 16)) AS UBIGINT) AS VARCHAR) AS seed FROM customer", "c_custkey", "", "seed")
register("function_hash_sampling", lambda s, d: r.table(s, d, "customer").where(x.hash_rate(F.col("c_name")) < 0.3).select("c_custkey"), "SELECT c_custkey FROM customer WHERE CAST(concat('0x', substr(sha1(c_name), 1, 13)) AS UBIGINT) / 4503599627370496.0 < 0.3", "c_custkey")


def grades(s, d):
    p = r.table(s, d, "part").select("p_partkey", (F.col("p_size") % 7 + 1).alias("a"), (F.col("p_size") % 5 + 1).alias("b"), (F.col("p_size") % 3 + 1).alias("c"), (F.col("p_size") % 2 + 1).alias("e"))
    return p.select("p_partkey", x.simplex(F.array(*(F.col(c).cast("double") for c in "abce"))).alias("p"))


P = "(SELECT p_partkey, a / t AS a, b / t AS b, c / t AS c, e / t AS e FROM (SELECT *, a + b + c + e AS t FROM (SELECT p_partkey, CAST(p_size % 7 + 1 AS DOUBLE) AS a, CAST(p_size % 5 + 1 AS DOUBLE) AS b, CAST(p_size % 3 + 1 AS DOUBLE) AS c, CAST(p_size % 2 + 1 AS DOUBLE) AS e FROM part)))"
register("function_grade_scalars", lambda s, d: grades(s, d).select("p_partkey", *(v.alias(f"{k}_value") for k, v in x.scalars(F.col("p")).items())), f"SELECT p_partkey, (b + 2 * c + 3 * e) / 3 AS expected_value, (m + greatest(a, b, c, e)) / 4 AS ordinal_value, m / 3.0 AS argmax_value, c + e AS binary_value, e AS very_value, (b + 3 * c + 7 * e) / 7 AS gain_value FROM (SELECT *, CASE WHEN a >= b AND a >= c AND a >= e THEN 0 WHEN b >= c AND b >= e THEN 1 WHEN c >= e THEN 2 ELSE 3 END AS m FROM {P})", "p_partkey", "expected_value ordinal_value argmax_value binary_value very_value gain_value")
register("function_entropy_calibration", lambda s, d: grades(s, d).select("p_partkey", x.entropy(F.col("p")).alias("h"), x.calibrated(F.col("p"), F.array(F.lit(0.4), F.lit(0.3), F.lit(0.2), F.lit(0.1)), 0.2)[0].alias("q")), f"SELECT p_partkey, h, greatest(a - 0.2 * h * 0.15, 0) / (greatest(a - 0.2 * h * 0.15, 0) + greatest(b - 0.2 * h * 0.05, 0) + greatest(c + 0.2 * h * 0.05, 0) + greatest(e + 0.2 * h * 0.15, 0)) AS q FROM (SELECT *, -(a * ln(a) + b * ln(b) + c * ln(c) + e * ln(e)) AS h FROM {P})", "p_partkey", "h q")
register("function_softmax_yes_no", lambda s, d: grades(s, d).select("p_partkey", x.softmax(F.col("p"))[1].alias("s"), x.yes_probability(F.col("p")[0], F.col("p")[1]).alias("y")), f"SELECT p_partkey, exp(b) / (exp(a) + exp(b) + exp(c) + exp(e)) AS s, 1 / (1 + exp(b - a)) AS y FROM {P}", "p_partkey", "s y")
register("function_scale_normalize", lambda s, d: r.table(s, d, "part").select("p_partkey", ((F.col("p_size") - 1) / F.when(F.col("p_partkey") % 2 == 0, 4.0).otherwise(100.0)).alias("v")), "SELECT p_partkey, (p_size - 1) / CASE WHEN p_partkey % 2 = 0 THEN 4.0 ELSE 100.0 END AS v FROM part", "p_partkey", "v")
register("function_labels", lambda s, d: r.cand(s, d).where("fs_rank < 20").select("qid", "docid", x.roman(F.col("fs_rank") + 1).alias("roman"), F.char((F.col("fs_rank") + 65)).alias("alpha")), "SELECT qid, docid, ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][CAST(fs_rank + 1 AS INT)] AS roman, chr(CAST(fs_rank + 65 AS INT)) AS alpha FROM pool", "qid docid", "", "roman alpha")
register("function_prompt_body", lambda s, d: r.pool(s, d, 3).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fs_rank", "docid"))), lambda v: F.concat(F.lit("["), (v["fs_rank"] + 1).cast("string"), F.lit("] "), v["docid"].cast("string"))), "\n").alias("body")), "SELECT qid, string_agg(concat('[', fs_rank + 1, '] ', docid), chr(10) ORDER BY fs_rank) AS body FROM cand WHERE fs_rank < 3 GROUP BY qid", "qid", "", "body")
register("function_half_up", lambda s, d: r.table(s, d, "orders").select("o_orderkey", x.half_up(F.col("o_totalprice") / 7, 3).alias("v")), "SELECT o_orderkey, round(CAST(o_totalprice / 7 AS DECIMAL(28, 10)), 3) AS v FROM orders", "o_orderkey", "v", digits=6)
register("function_loss_terms", lambda s, d: grades(s, d).agg(F.avg(F.pow(F.col("p")[0] - F.col("p")[1], 2)).alias("mse"), F.avg(F.aggregate(F.zip_with("p", F.array(*[F.lit(0.25)] * 4), lambda t, q: t * F.log(t / q)), F.lit(0.0), lambda a, v: a + v)).alias("kl")), f"SELECT avg(pow(a - b, 2)) AS mse, avg(a * ln(a / 0.25) + b * ln(b / 0.25) + c * ln(c / 0.25) + e * ln(e / 0.25)) AS kl FROM {P}", "", "mse kl")
register("function_redaction", lambda s, d: r.table(s, d, "customer").select("c_custkey", x.redacted(F.concat(F.lit('{"api_key": "'), "c_name", F.lit('", "name": "x"}'))).alias("t")), """SELECT c_custkey, '{"api_key": "***", "name": "x"}' AS t FROM customer""", "c_custkey", "", "t")
register("function_flatten_json", lambda s, d: r.table(s, d, "orders").select("o_orderkey", F.explode(F.from_json(F.to_json(F.struct(F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))), "map<string,double>")).alias("name", "v")), "SELECT o_orderkey, 'price' AS name, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, 'customer', o_custkey FROM orders", "o_orderkey", "v", "name", digits=4)
register("function_digests", lambda s, d: docs(s, d).select("doc_id", F.sha2("text", 256).alias("h")), "SELECT doc_id, sha256(text) AS h FROM documents", "doc_id", "", "h")


# generators
def table(s):
    return [1, 2]


register("generator_shuffles", lambda s, d: g.presented(r.pool(s, d), table(s)), None, "qid docid seed position")
register("generator_shuffles_complete", lambda s, d: g.presented(r.pool(s, d), table(s)).groupBy("qid", "seed").agg(F.count("*").alias("n"), F.count_distinct("position").alias("places"), F.max("position").alias("last")), "SELECT qid, v.seed, count(*) AS n, count(*) AS places, count(*) - 1 AS last FROM pool, (VALUES (1), (2)) v(seed) GROUP BY 1, 2", "qid seed n places last")
register("generator_injection", lambda s, d: g.injected(r.pool(s, d), r.pool(s, d).where("fs_rank = 1")), "SELECT p.qid, p.docid, a.place, CASE WHEN p.fs_rank = 1 THEN a.goal WHEN rest < a.goal THEN rest ELSE rest + 1 END AS position FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN fs_rank = 1 THEN 1 ELSE 0 END, fs_rank) - 1 AS rest FROM pool) p JOIN LATERAL (SELECT * FROM (VALUES ('top', 0), ('middle', p.n // 2), ('bottom', p.n - 1)) v(place, goal)) a ON true WHERE p.n > 1", "qid docid position", "", "place")
register("generator_units", lambda s, d: g.rendered(r.pool(s, d, 2).select("qid", "docid"), ["newline", "rule"], ["0-3", "0-10"]), "SELECT qid, docid, separator, scale FROM cand, (VALUES ('newline'), ('rule')) a(separator), (VALUES ('0-3'), ('0-10')) b(scale) WHERE fs_rank < 2", "qid docid", "", "separator scale")
register("generator_chunks", lambda s, d: g.chunks(g.presented(r.pool(s, d), table(s)), 4).groupBy("qid", "seed", "chunk").agg(F.count("*").alias("n")), "SELECT qid, v.seed, fs_rank // 4 AS chunk, count(*) AS n FROM pool, (VALUES (1), (2)) v(seed) GROUP BY 1, 2, 3", "qid seed chunk n")
register("generator_two_views", lambda s, d: g.two_views(r.pool(s, d).select("qid", F.floor(F.col("fs_rank") / 5).alias("chunk"), "docid")), "SELECT qid, chunk, view, docid, row_number() OVER (PARTITION BY qid, chunk, view ORDER BY md5(concat(docid, ':', view)), docid) - 1 AS slot FROM (SELECT qid, fs_rank // 5 AS chunk, docid, v.view FROM pool, (VALUES (0), (1)) v(view))", "qid chunk view docid slot")
register("generator_view_seed", lambda s, d: r.pool(s, d, 3).select("qid", "docid", g.view_seed(F.col("qid"), F.col("fs_rank"), F.lit(1)).cast("string").alias("seed")), "SELECT qid, docid, CAST(CAST(concat('0x', substr(sha1(concat(qid, ':', fs_rank, ':1')), 1, 16)) AS UBIGINT) AS VARCHAR) AS seed FROM cand WHERE fs_rank < 3", "qid docid", "", "seed")
register("generator_groups", lambda s, d: g.groups(g.presented(r.pool(s, d), table(s))).select("qid", "seed", F.size("docids").alias("n"), F.aggregate("docids", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total")), "SELECT qid, v.seed, count(*) AS n, sum(docid) AS total FROM pool, (VALUES (1), (2)) v(seed) GROUP BY 1, 2", "qid seed n total")
register("generator_schedule", lambda s, d: g.schedule(s, 12, [1, 2, 3], [5, 10]), "SELECT range AS epoch, range % 3 + 1 AS seed, CASE WHEN range % 2 = 0 THEN 5 ELSE 10 END AS width FROM range(12)", "epoch seed width")
register("generator_padding", lambda s, d: g.padded(r.table(s, d, "supplier").select("s_suppkey"), "s_suppkey", 7).groupBy("rank").agg(F.count("*").alias("n")), "SELECT r.range AS rank, CAST(ceil((SELECT count(*) FROM supplier) / 7.0) AS BIGINT) AS n FROM range(7) r", "rank n")
register("generator_batches", lambda s, d: g.batched(r.table(s, d, "supplier").select(F.col("s_suppkey").alias("key")), 3, 4), "SELECT key, i // 4 AS batch, i % 4 AS place FROM (SELECT s_suppkey AS key, row_number() OVER (ORDER BY md5(concat(s_suppkey, ':3')), s_suppkey) - 1 AS i FROM supplier)", "key batch place")
register("generator_work_items", lambda s, d: g.work_items(r.pool(s, d, 4), ["a", "b", "c"]).groupBy("qid", "prompt").agg(F.count("*").alias("n")), "SELECT qid, p.prompt, count(*) AS n FROM cand, (VALUES ('a'), ('b'), ('c')) p(prompt) WHERE fs_rank < 4 GROUP BY 1, 2", "qid n", "", "prompt")
register("generator_matrix", lambda s, d: g.matrix(s, lam=[1, 2, 3], k=[1, 10], base=["x", "y"]), "SELECT lam, k, base FROM (VALUES (1), (2), (3)) a(lam), (VALUES (1), (10)) b(k), (VALUES ('x'), ('y')) c(base)", "lam k", "", "base")


# scorers
def scored(s, d):
    return scorers.run(r.pool(s, d), log(s, d).select("qid", "docid", "perm_idx", "position"), "identity")


register("scorer_identity", scored, "SELECT qid, perm_idx, docid, position, n - position AS score FROM (SELECT *, count(*) OVER (PARTITION BY qid, perm_idx) AS n FROM score_log)", "qid perm_idx docid position", "score")
register("scorer_contract", lambda s, d: scorers.violations(log(s, d), log(s, d).where("not (docid % 5 = 0 and perm_idx = 1)").withColumn("score", F.when((F.col("docid") % 7 == 0) & (F.col("perm_idx") == 2), F.lit(float("nan"))).otherwise(F.col("score")))), "SELECT qid, perm_idx, docid, CASE WHEN perm_idx = 1 THEN 'lost' ELSE 'not_finite' END AS fault FROM score_log WHERE (docid % 5 = 0 AND perm_idx = 1) OR (docid % 7 = 0 AND perm_idx = 2)", "qid perm_idx docid", "", "fault")
register("scorer_pandas", lambda s, d: scorers.pandas_scorer(lambda a, b: a * 2.0 - b, ["score", "position"])(log(s, d)).groupBy("qid").agg(F.sum("score").alias("v")), "SELECT qid, sum(score * 2 - position) AS v FROM score_log GROUP BY qid", "qid", "v")
register("run_coverage_report", lambda s, d: scorers.coverage(r.cand(s, d), r.cand(s, d).where("not (qid % 5 = 0 and fs_rank > 2) and qid % 11 <> 0")), "SELECT reason, count(*) AS n FROM (SELECT qid, CASE WHEN qid % 11 = 0 THEN 'missing' WHEN qid % 5 = 0 AND max(fs_rank) > 2 THEN 'partial' ELSE 'complete' END AS reason FROM cand GROUP BY qid) GROUP BY 1", "n", "", "reason")


# streams
def events_dir(s, d):
    path = scratch(s, "events")
    r.table(s, d, "events").repartition(4).write.parquet(path)
    return path


def unique_name() -> str:
    from uuid import uuid4

    return f"totals_{uuid4().hex}"


register("stream_label_ingestion", lambda s, d: st.to_table(st.deduplicated(st.read_labels(s, events_dir(s, d)), ["user_id", "event_type"], "3650 days"), scratch(s, "labels"), scratch(s, "checkpoint")).groupBy("user_id").agg(F.count("*").alias("n")), "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1", "user_id n")
register("stream_running_cost", lambda s, d: st.totals(st.running_cost(st.read_labels(s, events_dir(s, d), 1)), unique_name()), "SELECT event_type, count(*) AS n, sum(value) AS cost FROM events GROUP BY 1", "n", "cost", "event_type", digits=4)
register("stream_progress", lambda s, d: st.totals(st.progress(st.read_labels(s, events_dir(s, d), 1), "3650 days", "1 day"), unique_name()).agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.sum("failures").alias("failures")), "SELECT count(DISTINCT CAST(ts AS DATE)) AS windows, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events", "windows n failures")
def budget(s, d):
    """One batch of four is written for the least budget, the rest by a second run without one."""
    files, labels, checkpoint = events_dir(s, d), scratch(s, "labels"), scratch(s, "checkpoint")
    first = st.ingest(st.read_labels(s, files, 1), labels, checkpoint, budget=1e-9, spark=s)
    some = s.read.parquet(labels).select("batch").distinct().count()
    st.ingest(st.read_labels(s, files, 1), labels, checkpoint, spark=s)
    done = s.read.parquet(labels)
    return done.agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches"), F.lit(some).alias("batches_before"), (F.sum("value") > first).cast("bigint").alias("more"), F.sum("value").alias("cost"))


register("stream_budget", budget, "SELECT count(*) AS n, 4 AS batches, 1 AS batches_before, 1 AS more, sum(value) AS cost FROM events", "n batches batches_before more", "cost", digits=4)
register("stream_resume", lambda s, d: st.resumed(r.table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("f")), r.table(s, d, "customer").where("c_custkey % 4 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("c_mktsegment")).alias("f")), "c_custkey", "f"), "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'mismatch' ELSE 'reuse' END AS state FROM customer", "c_custkey", "", "state")

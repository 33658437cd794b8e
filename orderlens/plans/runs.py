"""Queries of runs and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import generators, quality, runs, stability, statistics
from ..sources import relations as r
from ..sources.scratch import scratch
from .consumers import cells
from .contract import RELATIONS, register
from .stability import evaluated
from .statistics import trajectories

register(
    "run_experiment_identity", lambda s, d: runs.experiment(r.pool(s, d), r.qrels(s, d), "identity").drop("perm_idx"),
    """SELECT p.qid, CASE WHEN max(i.idcg) > 0 THEN sum(CASE WHEN fs_rank < 10 THEN rel / log2(fs_rank + 2) ELSE 0 END) / max(i.idcg) ELSE 0 END AS ndcg_cut, CASE WHEN max(n_rel) > 0 THEN sum(CASE WHEN rel > 0 THEN hits / CAST(fs_rank + 1 AS DOUBLE) ELSE 0 END) / max(n_rel) ELSE 0 END AS map,
        coalesce(1.0 / (min(CASE WHEN rel > 0 THEN fs_rank END) + 1), 0) AS recip_rank, CASE WHEN max(n_rel) > 0 THEN count(*) FILTER (WHERE rel > 0 AND fs_rank < 10) / CAST(max(n_rel) AS DOUBLE) ELSE 0 END AS recall
    FROM (SELECT p.*, q.rel, sum(CASE WHEN q.rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p.qid ORDER BY fs_rank) AS hits FROM pool p JOIN qrels q ON q.qid = p.qid AND q.docid = p.docid) p JOIN ideal i ON i.qid = p.qid GROUP BY p.qid""",
    "qid", "ndcg_cut map recip_rank recall",
)


def labelled_log(s, d):
    return r.score_log(s, d).withColumn("label", F.when(F.col("perm_idx") < 6, "random").otherwise("injected"))


def rebuilt(s, d):
    log = labelled_log(s, d)
    return runs.rebuilt([log.where("docid % 2 = 0"), log.where("docid % 2 = 1"), log.where("docid % 3 = 0")], r.qrels(s, d), "rand", 5)


register("run_psi_study", lambda s, d: evaluated(s, d).select("qid", "tau_psi", "ndcg"), "SELECT qid, tau_psi, ndcg FROM evaluated", "qid", "tau_psi ndcg")
register("run_rebuild_from_shards", lambda s, d: rebuilt(s, d).select("qid", "k", "tau", "ndcg"), "SELECT n.qid, count(*) AS k, max(t.tau) AS tau, avg(n.ndcg) AS ndcg FROM ndcg n LEFT JOIN (SELECT qid, avg((t * t - k) / CAST(k * (k - 1) AS DOUBLE)) AS tau FROM (SELECT qid, i, j, sum(s) AS t, count(*) AS k FROM docpairs WHERE perm_idx < 6 GROUP BY 1, 2, 3) GROUP BY qid) t ON t.qid = n.qid WHERE n.perm_idx < 6 GROUP BY n.qid", "qid k", "tau ndcg")
register(
    "run_geometry", lambda s, d: runs.geometry(r.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "pointwise").when(F.col("p_size") % 3 == 1, "pairwise").otherwise("listwise").alias("family"), F.col("p_size").alias("width"), F.lit(20).alias("depth"))),
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'document' WHEN p_size % 3 = 1 THEN 'pair' WHEN p_size >= 20 THEN 'pool' ELSE 'chunk' END AS context, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 WHEN p_size >= 20 THEN 20 ELSE p_size END AS context_width FROM part", "id context_width", "", "context",
)
register("run_analysis_by_name", lambda s, d: runs.analysis("tau-psi", r.score_log(s, d)), "SELECT qid, tau, tau_psi FROM psi", "qid", "tau tau_psi")


# Published summaries, and what analyses of them must give.
PAIRED = [("dl19", -0.12453829509565943), ("dl20", -0.10022123822201341)]
TAU_PSI, VERDICT_FLIP, PAIR_FLIP = [0.0694329339910735, 0.07427135553061479], [0.0385952208544533, 0.03794351918899348, 0.035119478638667635], [0.248, 0.470, 0.560, 0.634, 0.553]
GAINS = [-0.01, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09]
FIT_X = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45]
FIT_Y = [0.08081655535009518, 0.08339635617662949, 0.0859761570031638, 0.08855595782969811, 0.09113575865623242, 0.09371555948276674]
FIT_GROUPS = ["qwen3", "qwen3", "granite", "granite", "gemma", "gemma"]
EXPECTED = [
    ("bootstrap-ci", -0.11237976665883642, 1e-12), ("interval-below-zero", 1.0, 0.0), ("tau-psi", 0.07185214476084414, 1e-12), ("verdict-flip", 0.03721940622737147, 1e-12),
    ("pair-flip", 0.493, 1e-12), ("jaccard", 0.831, 1e-3), ("gain-histogram", 0.9, 0.01), ("calibration", 0.05159601653068623, 1e-12), ("absent", 0.0, 1.0),
]


def representative(s, d):
    """The analyses of the published summaries by the operators, against their published results; and one that nothing gives."""
    means = [(n, v) for n, vs in (("tau-psi", TAU_PSI), ("verdict-flip", VERDICT_FLIP), ("pair-flip", PAIR_FLIP)) for v in vs]
    values = s.createDataFrame(means, "name string, v double").groupBy("name").agg(F.avg("v").alias("value"))
    paired = statistics.exact_bootstrap(s.createDataFrame([(i, *p) for i, p in enumerate(PAIRED)], "qid int, dataset string, v double"), "v", "dataset")
    values = values.unionByName(paired.select(F.explode(F.array(F.struct(F.lit("bootstrap-ci").alias("name"), F.col("mean").alias("value")), F.struct(F.lit("interval-below-zero").alias("name"), (F.col("hi") < 0).cast("double").alias("value")))).alias("x")).select("x.*"))
    kept = s.range(59).select(F.explode(F.when(F.col("id") < 49, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("id") % 2).cast("int")))).alias("perm_idx"), F.col("id").alias("docid"), F.lit(1).alias("qid"))
    sets = kept.groupBy("qid", "perm_idx").agg(F.collect_set("docid").alias("x"))
    both = sets.groupBy("qid").agg(F.max_by("x", "perm_idx").alias("x"), F.min_by("x", "perm_idx").alias("y"))
    values = values.unionByName(both.select(F.lit("jaccard").alias("name"), (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("value")))
    values = values.unionByName(statistics.nonnegative_share(s.createDataFrame([(g,) for g in GAINS], "v double"), "v").select(F.lit("gain-histogram").alias("name"), F.col("share").alias("value")))
    fit = statistics.clustered_ols(s.createDataFrame(list(zip(FIT_X, FIT_Y, FIT_GROUPS, strict=True)), "x double, y double, g string"), "x", "y", "g")
    values = values.unionByName(fit.select(F.lit("calibration").alias("name"), F.col("slope").alias("value")))
    return runs.checked(values, s.createDataFrame(EXPECTED, "name string, target double, tolerance double")).select("name", "ok", F.col("value"))


register(
    "run_representative_checks", representative,
    "SELECT name, CASE WHEN name = 'absent' THEN 0 ELSE 1 END AS ok, value FROM (VALUES ('bootstrap-ci', -0.112379766659), ('interval-below-zero', 1.0), ('tau-psi', 0.071852144761), ('verdict-flip', 0.037219406227), ('pair-flip', 0.493), ('jaccard', 49 / 59.0), ('gain-histogram', 0.9), ('calibration', 0.051596016531), ('absent', NULL)) AS v(name, value)",
    "ok", "value", "name", digits=9,
)


def overrides(s, d):
    base = runs.merged({"eval": {"k": 10, "measures": ["map"]}, "seed": 1}, {"eval": {"k": 20}})
    flat = runs.flattened(runs.overridden(base, "eval.k=5", "model.name=small", "seed=3"))
    return s.createDataFrame([(k, str(v)) for k, v in flat.items()], "name string, v string")


register("run_config_overrides", overrides, "SELECT * FROM (VALUES ('eval.k', '5'), ('eval.measures', '[''map'']'), ('seed', '3'), ('model.name', 'small')) t(name, v)", "", "", "name v")
register("run_prompt_templates", lambda s, d: runs.echo(r.table(s, d, "part").select("p_partkey", runs.TEMPLATES["grade"](F.col("p_name"), F.col("p_type")).alias("prompt"))), "SELECT p_partkey, concat('Query: ', p_name, chr(10), 'Document: ', p_type, chr(10), 'Grade (0-3):') AS prompt, 'Grade (0-3):' AS prediction FROM part", "p_partkey", "", "prompt prediction")
register("run_retriever_inference", lambda s, d: r.table(s, d, "customer").select("c_custkey", runs.retriever(F.element_at(F.array(F.lit("run-BM25-dl19"), F.lit("splade_v3"), F.lit("bge-base"), F.lit("x")), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("v")), "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'sparse' WHEN 2 THEN 'dense' ELSE 'unknown' END AS v FROM customer", "c_custkey", "", "v")


def stored(s, d):
    per = quality.ndcg(r.ranked(r.score_log(s, d)), r.qrels(s, d)).where("perm_idx = 0")
    return runs.headline_and_detail(per, ["ndcg"], scratch(s, "metrics"))


register("run_metrics_headline", lambda s, d: stored(s, d)[0], "SELECT 'ndcg' AS measure, avg(ndcg) AS mean, coalesce(stddev_samp(ndcg), 0) AS std, count(*) AS n FROM ndcg WHERE perm_idx = 0", "n", "mean std", "measure")
register("run_metrics_detail", lambda s, d: stored(s, d)[1], "SELECT qid, perm_idx, ndcg FROM ndcg WHERE perm_idx = 0", "qid perm_idx", "ndcg")


def dataset(s, d):
    rows = r.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size")
    return runs.materialized(rows, F.col("p_name"), F.array("p_brand", "p_type"), F.col("p_size") % 2)


register("run_dataset_qrels", lambda s, d: dataset(s, d)["qrels"], "SELECT CAST(p_partkey AS VARCHAR) AS qid, concat(p_partkey, '-', i) AS docid, CASE WHEN p_size % 2 = i THEN 1 ELSE 0 END AS rel FROM part, (VALUES (0), (1)) v(i)", "rel", "", "qid docid")
register("run_dataset_run", lambda s, d: dataset(s, d)["run"], "SELECT CAST(p_partkey AS VARCHAR) AS qid, concat(p_partkey, '-', i) AS docid, i AS fs_rank, CASE i WHEN 0 THEN p_brand ELSE p_type END AS text FROM part, (VALUES (0), (1)) v(i)", "fs_rank", "", "qid docid text")
register("run_dataset_topics", lambda s, d: dataset(s, d)["topics"], "SELECT CAST(p_partkey AS VARCHAR) AS qid, p_name AS query FROM part", "", "", "qid query")
register("answer_last_boxed", lambda s, d: r.table(s, d, "part").select("p_partkey", runs.last_boxed(F.concat(F.lit("so \\boxed{1} or \\boxed { a{"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "}b } and \\boxed{open").otherwise("}b } and more}"))).alias("v")), "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN concat('a{', p_size, '}b') END AS v FROM part", "p_partkey", "", "v")
register("join_matched_anchors", lambda s, d: runs.matched_anchors(r.table(s, d, "orders").select(F.col("o_custkey").alias("qid"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("a")), "o_orderstatus", ["a"]), "SELECT o_custkey AS qid, count(DISTINCT o_orderstatus) AS n_arms, CASE WHEN count(DISTINCT substr(o_orderpriority, 1, 1)) = 1 THEN 1 ELSE 0 END AS matched FROM orders GROUP BY 1", "qid n_arms matched")
register("join_grouped_examples", lambda s, d: runs.grouped_examples(r.score_log(s, d).where("perm_idx = 0 and docid % 4 <> 0").select("qid", "docid", "score"), r.pool(s, d)).select("qid", F.array_join("docids", ",").alias("docids"), "n_missing"), "SELECT qid, coalesce(string_agg(CASE WHEN docid % 4 <> 0 THEN CAST(docid AS VARCHAR) END, ',' ORDER BY fs_rank), '') AS docids, count(*) FILTER (WHERE docid % 4 = 0) AS n_missing FROM pool GROUP BY qid", "qid n_missing", "", "docids")
register("run_collector", lambda s, d: runs.collected(r.table(s, d, "customer").select("c_custkey"), r.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "c_custkey", "o_orderkey").select("c_custkey", "ready", F.coalesce("o_orderkey", F.lit(-1)).alias("run")), "SELECT c_custkey, CASE WHEN max(o_orderkey) IS NULL THEN 0 ELSE 1 END AS ready, coalesce(max(o_orderkey), -1) AS run FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", "c_custkey ready run")
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
register(
    "run_paper_table", lambda s, d: runs.table_rows(cells(s, d), "dataset", SEGMENTS[:2], "variant", "ndcg").select("dataset", F.col("AUTOMOBILE").alias("a"), F.col("BUILDING").alias("b"), "complete"),
    "SELECT dataset, max(ndcg) FILTER (WHERE variant = 'AUTOMOBILE') AS a, max(ndcg) FILTER (WHERE variant = 'BUILDING') AS b, CASE WHEN count(*) FILTER (WHERE variant IN ('AUTOMOBILE', 'BUILDING')) = 2 THEN 1 ELSE 0 END AS complete FROM cells GROUP BY dataset", "complete", "a b", "dataset",
)
register("lambda_converged_best", lambda s, d: runs.converged_best(trajectories(s, d), 500), "SELECT lam, metric AS best, step FROM (SELECT *, row_number() OVER (PARTITION BY lam ORDER BY metric DESC, step) AS i FROM trajectories WHERE step >= 500) WHERE i = 1", "lam step", "best")
register("rank_stability_capped", lambda s, d: stability.mean_tau(r.ranked(r.score_log(s, d).where("perm_idx < 4"))), "SELECT qid, avg((t * t - k) / CAST(k * (k - 1) AS DOUBLE)) AS tau FROM (SELECT qid, i, j, sum(s) AS t, count(*) AS k FROM docpairs WHERE perm_idx < 4 GROUP BY 1, 2, 3) GROUP BY qid", "qid", "tau")
RELATIONS["prior"] = "SELECT avg(a) AS a, avg(b) AS b FROM (SELECT p_size / 50.0E0 AS a, 1 - p_size / 50.0E0 AS b FROM part)"


def calibrated(s, d):
    p = r.table(s, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, 1 - F.col("p_size") / 50.0).alias("p"))
    prior = p.agg(F.array(F.avg(F.col("p")[0]), F.avg(F.col("p")[1])).alias("prior"))
    return p.join(F.broadcast(prior)).select("p_partkey", x.calibrated(F.col("p"), F.col("prior"), 0.5)[0].alias("v"))


register("scorer_calibration", calibrated, "SELECT p_partkey, greatest(x.a - h * (p.a - 0.5), 0) / (greatest(x.a - h * (p.a - 0.5), 0) + greatest(x.b - h * (p.b - 0.5), 0)) AS v FROM (SELECT *, 0.5 * -(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END) AS h FROM (SELECT p_partkey, p_size / 50.0E0 AS a, 1 - p_size / 50.0E0 AS b FROM part)) x, prior p", "p_partkey", "v")
register("generator_request_units", lambda s, d: generators.batched(generators.work_items(r.pool(s, d, 1), ["a", "b"]).select(F.concat_ws("-", "qid", "docid", "prompt").alias("key")), 1, 8).groupBy("batch").agg(F.count("*").alias("n")), "SELECT (i - 1) // 8 AS batch, count(*) AS n FROM (SELECT row_number() OVER () AS i FROM (SELECT qid FROM pool WHERE fs_rank = 0), (VALUES ('a'), ('b')) v(p)) GROUP BY 1", "batch n")

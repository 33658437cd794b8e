"""Hand cases of the rules that differ from what one expects: ties, nulls, empty sets, single rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import consensus, consumers, decomposition, generators, quality, relational, runs, scorers, stability, statistics, thresholds
from orderlens.functions import text as x
from orderlens.sources import formats


def rankings(spark, *orders, qid=1):
    rows = [(qid, k, d, i, float(len(o) - i)) for k, o in enumerate(orders) for i, d in enumerate(o)]
    return spark.createDataFrame(rows, "qid bigint, perm_idx bigint, docid bigint, rnk bigint, score double")


def psi(spark, *orders):
    row = stability.mean_tau(rankings(spark, *orders)).select(stability.tau_psi(F.col("tau"))).first()
    return row[0] if row else None


def test_tau_psi_of_equal_and_reversed_orders(spark):
    assert psi(spark, [1, 2, 3], [1, 2, 3]) == 0
    assert psi(spark, [1, 2, 3], [3, 2, 1]) == 1
    assert psi(spark, [1, 2, 3]) is None  # one presentation
    assert psi(spark, [1], [1]) is None  # one document


def test_tau_on_common_documents_only(spark):
    row = stability.tau_of_pairs(rankings(spark, [1, 2, 3], [2, 9, 1])).first()
    assert (row.n_common, row.tau) == (2, -1.0)
    assert stability.tau_of_pairs(rankings(spark, [1, 2], [2, 7])).first().tau is None


def test_general_and_complete_tau_agree(spark):
    rng = random.Random(5)
    orders = [rng.sample(range(9), 9) for _ in range(4)]
    one = stability.mean_tau(rankings(spark, *orders)).first().tau
    two = stability.tau_of_pairs(rankings(spark, *orders)).agg(F.avg("tau")).first()[0]
    assert one == pytest.approx(two)


def test_rank_biased_overlap_of_equal_orders_is_one(spark):
    assert stability.rank_biased_overlap(rankings(spark, [1, 2, 3], [1, 2, 3])).first().rbo == pytest.approx(1)
    assert stability.rank_biased_overlap(rankings(spark, [1, 2], [3, 4])).first().rbo == pytest.approx(0)


def test_ndcg_without_ideal(spark):
    q = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "qid bigint, docid bigint, rel int")
    r = rankings(spark, [1, 2])
    assert quality.ndcg(r, q).first().ndcg == 0
    assert quality.ndcg(r, q, without="null").first().ndcg is None
    assert quality.ndcg(r, q, without="drop").count() == 0


def test_auc_is_null_if_one_sided(spark):
    q = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "qid bigint, docid bigint, rel int")
    assert quality.auc(rankings(spark, [1, 2]), q).first().auc is None


def sets(spark, *scores):
    rows = [(1, k, d, s, 1.0, 0) for k, row in enumerate(scores) for d, s in enumerate(row)]
    return spark.createDataFrame(rows, "qid bigint, perm_idx bigint, docid bigint, score double, tau double, rel int")


def test_two_empty_sets_are_equal_and_nothing_flips(spark):
    log = sets(spark, [0.1, 0.2], [0.3, 0.2])
    assert thresholds.jaccard(log).first().jaccard == 1
    assert thresholds.flip_rate(log).first().flip_rate is None
    row = thresholds.set_quality(log).first()
    assert (row.p, row.r, row.f1) == (0, 0, 0)


def test_threshold_keeps_ties(spark):
    assert thresholds.flip_rate(sets(spark, [1.0, 0.2], [1.0, 2.0])).first().flip_rate == 0.5


def test_one_query_has_no_deviation_but_one_seed_has_none(spark):
    one = spark.createDataFrame([(1, "a", "x", 42, 0.5)], "qid bigint, variant string, dataset string, training_seed int, v double")
    assert quality.over_queries(one, ["v"]).first()["std"] == 0
    assert consumers.macro(one, "v").first().sd is None


def test_not_a_number_is_left_out(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert tuple(quality.over_queries(rows, ["v"]).first()[1:]) == (2.0, pytest.approx(math.sqrt(2)), 2)


def test_mixed_delta_forms_are_not_averaged_and_modal_ties_take_the_least(spark):
    rows = spark.createDataFrame([(0.1, "strata", 10), (0.2, "range", 5)], "delta double, form string, k bigint")
    row = stability.combined_delta(rows).first()
    assert row.delta is None and row.modal_k == 5


def test_answers(spark):
    items = spark.createDataFrame([(1, 0, "", ""), (1, 1, "The cat!", "a cat"), (1, 2, "yes", "yes indeed"), (1, 3, "red red blue", "red blue blue")], "qid bigint, perm_idx bigint, prediction string, gold string")
    got = {r.perm_idx: (r.em, round(r.f1, 6)) for r in consumers.answer_scores(items).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (0, 0), 3: (0, round(2 / 3, 6))}


def test_majority_prefers_the_first_met(spark):
    items = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "qid bigint, perm_idx bigint, prediction string")
    row = consumers.majority(items, F.col("prediction")).first()
    assert (row.answer, row.votes, row.flip) == ("b", 2, 0.5)


def test_invalid_verdicts_are_a_class(spark):
    items = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "NEI")], "qid bigint, perm_idx bigint, prediction string")
    row = consumers.verdict_per_query(items, F.lit("NEI")).first()
    assert row.answer == consumers.INVALID and row.invalid == pytest.approx(2 / 3) and row.accuracy == pytest.approx(1 / 3)


def test_identifiers_with_slashes(spark):
    row = spark.range(1).select(x.path_safe(F.lit("a/b/c")).alias("s")).select("s", x.path_restored(F.col("s")).alias("r")).first()
    assert tuple(row) == ("a__SLASH__b__SLASH__c", "a/b/c")


def test_stable_seed_is_that_of_python(spark):
    assert int(spark.range(1).select(x.stable_seed(F.lit("a"), F.lit("b"))).first()[0]) == 6463353407833682387


def test_permutation_of_a_reply(spark):
    row = spark.range(1).select(x.permutation(F.lit("[3] > [1] > [3] > [77]"), 4).alias("p"), x.permutation(F.lit("none"), 2).alias("q")).first()
    assert (row.p, row.q) == ([2, 0, 1, 3], [0, 1])


def test_half_up(spark):
    assert float(spark.range(1).select(x.half_up(F.lit(0.0005), 3)).first()[0]) == 0.001


def test_jaccard_of_the_published_sets(spark):
    a, b = set(range(54)), set(range(5, 59))
    rows = [(1, k, d, 1.0 if d in s else 0.0, 1.0) for k, s in enumerate((a, b)) for d in a | b]
    log = spark.createDataFrame(rows, "qid bigint, perm_idx bigint, docid bigint, score double, tau double")
    assert thresholds.jaccard(log).first().jaccard == pytest.approx(49 / 59)


def test_score_ties_go_by_docid_and_copeland_refines(spark):
    margins = spark.createDataFrame([(1, 1, 2, 0.0), (1, 1, 3, 2.0), (1, 2, 3, 1.0)], "qid bigint, a bigint, b bigint, margin double")
    got = {r.docid: r.score for r in consensus.copeland(margins).collect()}
    assert got[1] > got[2] > got[3] and got[1] == pytest.approx(1.5 + 0.001 * 2 / 3)


def test_fixed_effects_close(spark):
    rows = [(1, d, p % 2, p // 2, float(d + (p % 2) * 0.5)) for d in range(4) for p in range(4)]
    row = decomposition.fixed_effects(spark.createDataFrame(rows, "qid bigint, docid bigint, slot bigint, chunk bigint, score double")).first()
    assert row.residual == pytest.approx(0, abs=1e-12) and row.document + row.slot + row.chunk == pytest.approx(row.total)


def test_shuffles_are_those_of_python(spark):
    order = list(range(7))
    random.Random(3).shuffle(order)
    got = sorted((r.position, r.i) for r in generators.shuffles(spark.createDataFrame([(7,), (7,)], "n bigint"), [3]).collect())
    assert [i for _, i in got] == order


def test_padding_fills_every_rank(spark):
    rows = generators.padded(spark.range(10), "id", 4)
    assert {r["count"] for r in rows.groupBy("rank").count().collect()} == {3}


def test_scorer_faults(spark):
    given = rankings(spark, [1, 2, 3])
    scored = given.where("docid <> 1").unionByName(given.where("docid = 2")).unionByName(given.where("docid = 3").withColumn("docid", F.lit(9).cast("bigint")))
    assert {(r.docid, r.fault) for r in scorers.violations(given, scored).collect()} == {(1, "lost"), (2, "repeated"), (9, "added")}
    with pytest.raises(ValueError):
        scorers.scorer("identity")(scorers.identity)


def test_unpaired_keys(spark):
    a, b = spark.range(0, 3), spark.range(1, 4)
    assert {tuple(r) for r in relational.unpaired(a, b, ["id"]).collect()} == {(0, "left"), (3, "right")}


def test_exact_bootstrap_is_that_of_one_seeded_stream(spark):
    rows = [(i, "ab"[i % 3 == 0], float(i * i % 7)) for i in range(9)]
    df = spark.createDataFrame(rows, "qid bigint, dataset string, v double")
    arrays = [np.array([v for _, d, v in rows if d == n]) for n in "ab"]
    rng, drawn = np.random.default_rng(5), []
    for _ in range(300):
        drawn.append(np.mean([arrays["ab".index(n)][rng.integers(0, arrays["ab".index(n)].size, size=arrays["ab".index(n)].size)].mean() for n in rng.choice(["a", "b"], size=2, replace=True)]))
    got = statistics.exact_bootstrap(df, "v", "dataset", 300, 5).first()
    assert got.mean == pytest.approx(np.mean([a.mean() for a in arrays])) and [got.lo, got.hi] == pytest.approx(list(np.quantile(drawn, [0.025, 0.975])))
    values = np.array([v for _, _, v in rows])
    want = np.quantile(values[np.random.default_rng(5).integers(0, 9, size=(300, 9))].mean(axis=1), [0.025, 0.975])
    got = statistics.exact_bootstrap(df, "v", None, 300, 5).first()
    assert [got.lo, got.hi] == pytest.approx(list(want))


def test_poisson_bootstrap_weighs_equal_values_apart(spark):
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "qid bigint, v double")
    got = statistics.poisson_bootstrap(rows, "v").first()
    assert got.estimate == 0.5 and 0.03 < got.hi - got.lo < 0.16  # two standard errors to each side are 0.05
    with pytest.raises(ValueError, match="drawn by"):
        statistics.poisson_bootstrap(rows.drop("qid"), "v")


def test_mean_tau_of_presentations_that_lack_documents(spark):
    rank = lambda *orders: stability.mean_tau(rankings(spark, *orders)).collect()
    assert [r.tau for r in rank([1, 2, 3], [1, 2], [1, 2, 3])] == [1.0]
    assert [r.tau for r in rank([1, 2, 3], [1, 3], [2, 3])] == [1.0]
    assert [r.tau for r in rank([1, 2, 3], [3, 1])] == [-1.0]
    assert [r.tau for r in rank([1, 2], [3, 4])] == [None] and rank([1], [1]) == []


def test_nearest_donors_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([5, 5, 5, 900, 901, 40, 7000]) if i % 3 else rng.randint(0, 99), rng.choice("aaaab")) for i in range(200)] + [(200, None, "a"), (201, 4, None)]
    got = {r.k: r.gap for r in relational.nearest_donors(spark.createDataFrame(rows, "k bigint, n bigint, o string"), "k", "n", "o").collect()}
    full = [r for r in rows if None not in r]
    assert got == {k: min(abs(n - m) for _, m, p in full if p != o) for k, n, o in full}
    alone = spark.createDataFrame([(1, 2, "a"), (2, 9, "a")], "k bigint, n bigint, o string")
    assert relational.nearest_donors(alone, "k", "n", "o").count() == 0


def test_shuffles_of_any_pool_size(spark):
    pool = spark.range(250).select(F.lit(1).cast("bigint").alias("qid"), F.col("id").alias("docid"), F.col("id").alias("fs_rank"))
    got = [r.docid for r in generators.presented(pool, [9]).orderBy("position").collect()]
    want = list(range(250))
    random.Random(9).shuffle(want)
    assert got == want


def test_last_line_wins_over_several_files(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.txt").write_text("1 0 d 3\n" + "2 0 x 1\n" * 5000)
    (tmp_path / "q" / "b.txt").write_text("1 0 d 1\n")
    assert {(r.qid, r.docid): r.rel for r in formats.read_qrels(spark, str(tmp_path / "q")).collect()} == {("1", "d"): 1, ("2", "x"): 1}


@pytest.mark.parametrize(("text", "want"), [(r"\boxed{1} \boxed{a{2}b}", "a{2}b"), (r"\boxed{1} \boxed{open", None), (r"\boxed  { x }", "x"), (r"\boxed", None), ("", None), (None, None), (r"\boxed{1} \boxed 2", None)])
def test_last_boxed(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(runs.last_boxed("t").alias("v")).first().v == want


def test_finite_drops_nulls_nans_and_infinities(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (-float("inf"),), (-2.0,)], "v double")
    assert sorted(r.v for r in relational.finite(rows, "v").collect()) == [-2.0, 1.0]


def test_normal_cdf(spark):
    row = spark.range(1).select(statistics.normal_cdf(F.lit(1.96)).alias("a"), statistics.normal_cdf(F.lit(-1.0)).alias("b")).first()
    assert row.a == pytest.approx(0.9750021, abs=2e-7) and row.b == pytest.approx(0.1586553, abs=2e-7)


def test_borda_needs_no_join_and_leaves_out_queries_with_fewer_rankings(spark):
    """The query's presentations are counted where its rows are; rows of the null query are one query, as in SQL."""
    rows = rankings(spark, [1, 2], [2, 1], [2, 1]).unionByName(rankings(spark, [3, 4], [4, 3], qid=2)).unionByName(rankings(spark, [5], [5], [5], qid=None))
    got = consensus.borda(rows, [1, 2, 3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 1
    assert {(r.qid, r.perm_idx, r.docid, r.rnk) for r in got.collect()} == {
        (1, 1, 1, 0), (1, 1, 2, 1), (1, 2, 1, 0), (1, 2, 2, 1), (1, 3, 2, 0), (1, 3, 1, 1), (2, 1, 3, 0), (2, 1, 4, 1), (2, 2, 3, 0), (2, 2, 4, 1), (None, 1, 5, 0), (None, 2, 5, 0), (None, 3, 5, 0),
    }


def test_run_scores_are_raw_only_if_they_fall(spark):
    falling, tied = rankings(spark, [1, 2, 3]), rankings(spark, [1, 2, 3], qid=2).withColumn("score", F.lit(1.0))
    lines = {tuple(r.value.split(" ")[:5:2]): r.value.split(" ")[4] for r in formats.run_lines(falling.unionByName(tied), "t").collect()}
    assert {v for k, v in lines.items() if k[0] == "2"} == {"3.0", "2.0", "1.0"}


def test_bad_run_lines_are_marked(spark, tmp_path):
    (tmp_path / "run.txt").write_text("q Q0 d 1 0.5 t\nq Q0 d x 0.5 t\nshort line\n")
    assert sorted(r.bad for r in formats.read_run(spark, str(tmp_path)).collect()) == [False, True, True]


def test_sorted_runs_keep_each_query_in_one_task(spark):
    """Queries of as many rows as a range has, so that ranges of rows would cut some."""
    run = spark.range(0, 6000, 1, 4).select(F.concat(F.lit("q"), F.col("id") % 5).alias("qid"), (5999 - F.col("id")).alias("rank"), F.lit(False).alias("bad"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = formats.sorted_run(run).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [(r.qid, r.rank) for r in got] == sorted((r.qid, r.rank) for r in got) and len(got) == 6000
    assert len({(r.qid, r.task) for r in got}) == 5 and len({r.task for r in got}) > 1


def test_last_judgment_wins(spark, tmp_path):
    (tmp_path / "q.txt").write_text("q 0 d 1\nq 0 d 3\nq 0 e 2\nshort\n")
    assert {tuple(r) for r in formats.read_qrels(spark, str(tmp_path)).collect()} == {("q", "d", 3), ("q", "e", 2)}


@pytest.mark.parametrize("per_range", [1, 3, 10, 1000])
def test_regrouped_by_ranges_of_lines(spark, per_range):
    rng = random.Random(per_range)
    lines = sorted(rng.sample(range(200), 40)) + [(7 << 33) + i for i in range(40)]
    keys = [rng.choice(["a", "b", None]) for _ in lines[:-10]] + ["late"] * 4 + ["a"] + ["once"] * 3 + ["late"] * 2
    starts = [k for p, k in zip([None, *keys], keys) if p != k]
    got = {r.k: r.n_groups for r in formats.regrouped(spark.createDataFrame(list(zip(lines, keys)), "line bigint, k string").repartition(5), "k", "line", per_range).collect()}
    assert got == {k: starts.count(k) for k in starts if starts.count(k) > 1} and got["late"] == 2 and "once" not in got
    one = spark.createDataFrame([(5, "a")], "line bigint, k string")
    assert formats.regrouped(one, "k", "line", per_range).count() == formats.regrouped(one.where("false"), "k", "line", per_range).count() == 0


def test_dense_search_in_blocks(spark):
    rng = random.Random(5)
    vectors = {i: [rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)] for i in range(60)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    want = {(q, d, i + 1) for q, v in vectors.items() for i, d in enumerate(sorted(vectors, key=lambda d: (-sum(a * b for a, b in zip(v, vectors[d])), d))[:4])}
    for block in (60, 25):
        assert {(r.qid, r.docid, r["rank"]) for r in formats.dense_top_k(table, table, "vec_id", "embedding", 4, block).collect()} == want


def bm25_by_hand(queries, docs, k, k1=0.9, b=0.4):
    words = {d: t.lower().split() for d, t in docs.items()}
    mean, out = sum(map(len, words.values())) / len(words), set()
    for q, text in queries.items():
        score = {}
        for w in set(text.lower().split()):
            df = sum(w in v for v in words.values())
            for d, v in words.items():
                if tf := v.count(w):
                    score[d] = score.get(d, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(v) / mean))
        out |= {(q, d, i + 1) for i, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 6), d))[:k])}
    return out


def test_bm25_query_searches_for_every_item(spark, tmp_path):
    from orderlens.plans.registry import QUERIES

    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("Ab c d e f g h i j".split()) for _ in range(n))
    items, docs = {i: text(4) for i in range(0, 120, 5)}, {i: text(rng.randint(1, 12)) for i in range(40)}
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.qid, r.docid, r["rank"]) for r in QUERIES["source_bm25_first_stage"](spark, str(tmp_path)).collect()}
    assert got == bm25_by_hand(items, docs, 10)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    by_shuffles = formats.bm25(read("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), read("documents"), "doc_id", "text", 10, most=0)
    assert {(r.qid, r.docid, r["rank"]) for r in by_shuffles.collect()} == got


def test_fixed_effects_equal_dense_least_squares(spark, sf):
    from orderlens.sources import relations as r

    rows = decomposition.slots(r.score_log(spark, sf), 5).where("(docid + perm_idx) % 7 <> 0").cache()  # presentations that lack documents
    want = {}
    for qid, g in rows.toPandas().groupby("qid"):
        y, x = g["score"].to_numpy(), np.ones((len(g), 1))
        left = [y.var()]
        for c in ("docid", "slot", "chunk"):
            x = np.hstack([x, (g[c].to_numpy()[:, None] == np.unique(g[c])[None, :]).astype(float)])
            left.append(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).mean())
        want[qid] = [left[0], left[0] - left[1], left[1] - left[2], left[2] - left[3], left[3]]
    got = {r.qid: [r.total, r.document, r.slot, r.chunk, r.residual] for r in decomposition.fixed_effects(rows).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for qid in want:
        assert got[qid] == pytest.approx(want[qid], abs=1e-10)
    shares = decomposition.shares(decomposition.fixed_effects(rows)).first()
    slot, chunk, rest, total = (sum(w[i] for w in want.values()) for i in (2, 3, 4, 0))
    assert [shares.pooled, shares.slot_share, shares.chunk_share] == pytest.approx([(slot + chunk + rest) / total, slot / (slot + chunk + rest), chunk / (slot + chunk + rest)])


def test_aligned_summary_of_queries_that_lack_scores(spark):
    rows = [(1, 0, 1, 0.5), (1, 0, 2, 0.25), (1, 1, 1, 0.5), (2, 0, 1, 1.0), (2, 1, 1, 2.0), (3, 0, 1, 1.0), (3, 0, 2, None), (3, 1, 1, 1.0), (3, 1, 2, 0.0)]
    rows += [(4, 0, 1, 3.0), (4, 0, 2, 1.0), (4, 1, 1, 2.0), (4, 1, 2, 2.0)]
    found = {r.qid: r for r in stability.aligned_summary(spark.createDataFrame(rows, "qid bigint, perm_idx bigint, docid bigint, score double")).collect()}
    assert all(found[q].p50 is None and found[q].rbo is None for q in (1, 2, 3))
    assert (found[1].n_documents, found[1].n_presentations, found[2].n_documents) == (2, 2, 1)
    one = found[4]
    assert (one.residual_variance, one.centred_variance, one.dispersion_variance, one.dispersion, one.order_variance) == (0.25, 0.25, 0.5, 0.5, 0.25)
    assert (one.margin_mean, one.tie_rate, one.margin_cutoff_mean, one.tau_psi, one.rbo) == (1.0, 0.5, None, 0.0, pytest.approx(1))


def test_study_of_queries_without_judgments(spark):
    qrels = spark.createDataFrame([(1, 2, 1), (1, 2, 2)], "qid bigint, docid bigint, rel int")
    order = rankings(spark, [1, 2, 3], [2, 1, 3]).unionByName(rankings(spark, [5, 6], qid=2)).withColumn("position", F.col("rnk"))
    found = {r.qid: r for r in stability.evaluate(order, qrels).collect()}
    assert found[1].k == 2 and found[1].greatest == 1 and found[1].least == pytest.approx(1 / math.log2(3))
    assert found[1].tau == pytest.approx(1 / 3)
    assert (found[2].k, found[2].ndcg, found[2].tau, found[2].gold_rank_variance, found[2].zeng_psi) == (1, 0, None, None, None)


def test_equivalence_without_error(spark):
    rows = spark.createDataFrame([(0.01, 0.0), (0.05, 0.0), (-0.2, 0.0), (0.0, 0.01), (None, 0.0)], "m double, se double")
    found = [r[0] for r in rows.select(statistics.equivalence(F.col("m"), F.col("se"), 0.05)).collect()]
    assert found[:3] == [0.0, 1.0, 1.0] and found[3] < 1e-5 and found[4] is None

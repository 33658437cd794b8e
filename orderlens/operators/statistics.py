"""Statistics: bootstraps, equivalence, calibration, correlations, label distributions, and choices among checkpoints and penalties."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPLICATES = 200


def poisson_bootstrap(rows: DataFrame, value: str, *strata: str, key: str = "qid", replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """(estimate, lo, hi): mean of the strata's means, and its percentile interval over replicates in which each row weighs Poisson(1).

    A row's weights come from a hash of its key, its strata and the replicate, so replicates need no shuffle of rows and partial sums are all that moves: replicates x
    strata. Rows with equal values but other keys are weighed apart; rows with the same key in a stratum stay together, as a cluster.
    """
    if key not in rows.columns:
        raise ValueError(f"rows have no {key} to be drawn by")
    key = F.xxhash64(key, *strata)
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = lambda x: sum((F.when(x > c, 1).otherwise(0) for c in cuts), F.lit(0))
    flat = rows.select(*strata, F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b"), key.alias("_k"))
    flat = flat.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(weight((F.pmod(F.xxhash64("_k", "b", F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40))))
    means = flat.groupBy("b", *strata).agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n")).where("n > 0").groupBy("b").agg(F.avg(F.col("s") / F.col("n")).alias("m"))
    ok = F.when(F.col("b") > 0, F.col("m"))
    return means.agg(F.max(F.when(F.col("b") == 0, F.col("m"))).alias("estimate"), F.percentile(ok, F.lit(0.025)).alias("lo"), F.percentile(ok, F.lit(0.975)).alias("hi"))


def exact_bootstrap(rows: DataFrame, value: str, dataset: str | None, samples: int = 20_000, seed: int = 4401, key: str = "qid") -> DataFrame:
    """(mean, lo, hi): the mean of datasets' means (of all values without a dataset) and the percentile interval by one stream of numpy's seeded generator.

    With datasets, each sample draws datasets, in the order of their names, and then values of each; without, it draws values. For evaluation tables (a value per query and
    dataset, in the order of `key`), which are gathered in one task; one stream of a generator cannot be split.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.sort_values(["d", "k"], kind="stable")
        arrays = [g["v"].to_numpy(np.float64) for _, g in frame.groupby("d", sort=True)]
        rng = np.random.default_rng(seed)
        if dataset is None:
            n, drawn, done = len(arrays[0]), np.empty(samples), 0
            while done < samples:
                some = min(samples - done, max(1, 2_000_000 // n))
                drawn[done : done + some] = arrays[0][rng.integers(0, n, size=(some, n))].mean(axis=1)
                done += some
        else:
            count = len(arrays)
            drawn = np.array([np.mean([arrays[i][rng.integers(0, arrays[i].size, size=arrays[i].size)].mean() for i in rng.integers(0, count, size=count)]) for _ in range(samples)])
        lo, hi = np.quantile(drawn, [0.025, 0.975])
        return pd.DataFrame({"mean": [float(np.mean([a.mean() for a in arrays]))], "lo": [float(lo)], "hi": [float(hi)]})

    table = rows.select((F.col(dataset) if dataset else F.lit("")).cast("string").alias("d"), F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    return table.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda _, frame: run(frame), "mean double, lo double, hi double")


def normal_cdf(z: Column) -> Column:
    """By Abramowitz and Stegun 7.1.26 (error below 1.5e-7); SQL has no erf."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: the polynomial's coefficients
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def equivalence(estimate: Column, se: Column, margin: float) -> Column:
    """The larger p-value of the two one-sided tests that an effect lies within the margin; without any error 0 inside it and else 1."""
    tests = F.greatest(1 - normal_cdf((estimate + margin) / se), normal_cdf((estimate - margin) / se))
    return F.when(se == 0, F.when(F.abs(estimate) < margin, 0.0).when(F.abs(estimate) >= margin, 1.0)).otherwise(tests)


def contrast(estimate: Column, lo: Column, hi: Column, wins: Column, n: Column) -> Column:
    """Reasons to run more seeds."""
    return F.array_compact(F.array(F.when((lo <= 0) & (hi >= 0), "interval_spans_zero"), F.when(F.abs(estimate) < (hi - lo) / 2, "effect_below_half_width"), F.when(wins * 2 < n, "minority_of_wins")))


def gain_histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n): half-open bins, the last one closed; a row for each bin."""
    bin_of = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        last = i == len(edges) - 2
        bin_of = F.when((F.col(value) >= a) & ((F.col(value) <= b) if last else (F.col(value) < b)), i).otherwise(bin_of)
    counts = rows.select(bin_of.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def nonnegative_share(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, and the share of gains that are not negative."""
    return rows.agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg((F.col(value) >= 0).cast("double")).alias("share"))


def clustered_ols(rows: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """One row: slope, intercept, and the cluster-robust (CR1) standard error of the slope; all from sums."""
    fit = rows.agg(F.avg(x).alias("mx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.count("*").alias("n"))
    scores = rows.join(F.broadcast(fit)).withColumn("u", (F.col(x) - F.col("mx")) * (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)))
    per = scores.groupBy(cluster).agg(F.sum("u").alias("u"), *(F.first(c).alias(c) for c in ("slope", "intercept", "sxx", "n")))
    agg = per.agg(F.sum(F.col("u") * F.col("u")).alias("meat"), F.count("*").alias("g"), *(F.first(c).alias(c) for c in ("slope", "intercept", "sxx", "n")))
    scale = F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - 2)
    return agg.select("slope", "intercept", F.sqrt(scale * F.col("meat")).alias("_s"), "sxx", "g", "n").select("slope", "intercept", (F.col("_s") / F.col("sxx")).alias("se"), "g", "n")


def prediction_diagnostics(rows: DataFrame, p: str, t: str) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(t), 2)).alias("mse"), F.corr(p, t).alias("pearson"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"), F.count("*").alias("n"))


def distribution(rows: DataFrame, value: str, least: float, most: float, near: float) -> DataFrame:
    """One row: moments, shares near the ends and near integers, the share of the most frequent value at six places."""
    modal = rows.groupBy(F.round(value, 6).alias("v")).agg(F.count("*").alias("c")).agg(F.max("c").alias("c"))
    v = F.col(value)
    agg = rows.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.avg(((v <= least + near) | (v >= most - near)).cast("int")).alias("near_ends"), F.avg((F.abs(v - F.bround(v)) <= near).cast("int")).alias("near_integers"))
    return agg.join(F.broadcast(modal)).withColumn("modal", F.col("c") / F.col("n")).drop("c")


def separation(rows: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row: means of both sides and their distance in pooled deviations."""
    a, b = F.when(positive, F.col(value)), F.when(~positive, F.col(value))
    agg = rows.agg(F.avg(a).alias("positive"), F.avg(b).alias("negative"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    return agg.select("positive", "negative", F.when(F.col("va") + F.col("vb") > 0, (F.col("positive") - F.col("negative")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("separation"))


def one_standard_error(rows: DataFrame, floor: float) -> DataFrame:
    """One row from (lam, step, metric, sd): the best metric's lam among runs that did not collapse (sd of at least the floor), and the largest lam whose best is within one standard error (of the lams' bests) of it."""
    best = rows.where(F.col("sd") >= floor).groupBy("lam").agg(F.max("metric").alias("best"))
    top = best.agg(F.max("best").alias("top"), F.max_by("lam", F.struct("best", -F.col("lam"))).alias("argmax"), F.coalesce(F.stddev_samp("best") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"))
    return best.join(F.broadcast(top)).where(F.col("best") >= F.col("top") - F.col("se")).agg(F.max("lam").alias("lam"), F.first("argmax").alias("argmax"), F.first("top").alias("top"), F.count("*").alias("n_band"))


def least_matching(rows: DataFrame, target: float) -> DataFrame:
    """The least lam whose instability reaches the target."""
    return rows.where(F.col("psi") <= target).agg(F.min("lam").alias("lam"))


def best_checkpoints(rows: DataFrame, n: int, later_wins: bool) -> DataFrame:
    """The n best steps of each run; exact ties go to the later or the earlier step."""
    order = Window.partitionBy("run").orderBy(F.desc("metric"), F.desc("step") if later_wins else F.col("step"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def screen(rows: DataFrame, low: float, high: float) -> DataFrame:
    """(run, verdict) by the median of a curve: LOWER, PASS or RAISE, ABSTAIN below three points."""
    agg = rows.groupBy("run").agg(F.count("*").alias("n"), F.percentile("metric", F.lit(0.5)).alias("median"))
    return agg.select("run", "median", F.when(F.col("n") < 3, "ABSTAIN").when(F.col("median") < low, "LOWER").when(F.col("median") > high, "RAISE").otherwise("PASS").alias("verdict"))


def slot_weights(rows: DataFrame, width: int, clip: float) -> DataFrame:
    """(slot, n, propensity, weight): how often the positive stood in each slot, with one added, and the inverse, clipped, with mean 1."""
    counts = rows.groupBy((F.col("position") % width).alias("slot")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(width).toDF("slot").join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    p = (F.col("n") + 1) / F.sum(F.col("n") + 1).over(w)
    raw = spine.withColumn("propensity", p).withColumn("_w", F.least(F.lit(clip), 1 / (width * F.col("propensity"))))
    return raw.select("slot", "n", "propensity", (F.col("_w") / F.avg("_w").over(w)).alias("weight"))


def prompt_percentiles(rows: DataFrame, chars: str, shares: list[int]) -> DataFrame:
    """(share, value): nearest-rank percentiles, the rank rounded half to even; from the histogram of lengths, so only distinct lengths are sorted."""
    hist = rows.groupBy(F.col(chars).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    cum = hist.withColumn("_c", F.sum("n").over(w.orderBy("v"))).withColumn("_t", F.sum("n").over(w)).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return cum.where(F.col("_c") > F.bround(F.col("share") / 100 * (F.col("_t") - 1))).groupBy("share").agg(F.min("v").alias("value"))


def cost_state(events: DataFrame) -> DataFrame:
    """(kind, n, cost, users, cost_per_user, failures)."""
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("cost"), F.count_distinct("user_id").alias("users"), (F.sum("value") / F.count_distinct("user_id")).alias("cost_per_user"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"))

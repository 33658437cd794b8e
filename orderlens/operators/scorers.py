"""Scorers: an interface, a registry, the identity scorer, and the check of what a scorer returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A scorer takes (qid, perm_idx, docid, position, text and what else it needs) and adds score.
Scorer = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        if name in REGISTRY:
            raise ValueError(f"there is a scorer {name} already")
        REGISTRY[name] = f
        return f

    return add


@scorer("identity")
def identity(rows: DataFrame) -> DataFrame:
    """The first-stage order, with falling scores."""
    n = rows.groupBy("qid", "perm_idx").agg(F.count("*").alias("_n"))
    return rows.join(n, ["qid", "perm_idx"]).withColumn("score", (F.col("_n") - F.col("position")).cast("double")).drop("_n")


@scorer("length")
def length(rows: DataFrame) -> DataFrame:
    """Longer texts first: a deterministic scorer for tests."""
    return rows.withColumn("score", F.length("text").cast("double"))


def pandas_scorer(score, columns: list[str]) -> Scorer:
    """A scorer from a function of pandas columns to a column of scores, in Arrow batches; where a model is called."""

    def apply(rows: DataFrame) -> DataFrame:
        f = F.pandas_udf(score, "double")
        return rows.withColumn("score", f(*columns))

    return apply


def violations(given: DataFrame, scored: DataFrame) -> DataFrame:
    """(qid, perm_idx, docid, fault): documents that a scorer lost, added, repeated, or gave no finite score."""
    key = ["qid", "perm_idx", "docid"]
    g = given.select(*key).withColumn("_g", F.lit(1))
    s = scored.groupBy(*key).agg(F.count("*").alias("_n"), F.max("score").alias("_s"))
    both = g.join(s, key, "full_outer")
    bad = F.col("_s").isNull() | F.isnan("_s") | (F.abs("_s") == float("inf"))
    fault = F.when(F.col("_n").isNull(), "lost").when(F.col("_g").isNull(), "added").when(F.col("_n") > 1, "repeated").when(bad, "not_finite")
    return both.select(*key, fault.alias("fault")).where("fault is not null")


def coverage(work: DataFrame, done: DataFrame) -> DataFrame:
    """(reason, n): how many queries are complete, partial or missing."""
    w = work.groupBy("qid").agg(F.count("*").alias("_w"))
    d = done.groupBy("qid").agg(F.count("*").alias("_d"))
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("_d") < F.col("_w"), "partial").otherwise("complete")
    return w.join(d, "qid", "left").select(state.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def run(pool: DataFrame, presentations: DataFrame, name: str) -> DataFrame:
    """A score log: pools under presentations (qid, docid, perm_idx, position), scored by a registered scorer."""
    return REGISTRY[name](presentations.join(pool, ["qid", "docid"])).select("qid", "perm_idx", "docid", "position", "score")

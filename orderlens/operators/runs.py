"""Runs and studies: from pools through a scorer to figures, rebuilding from shards, collecting runs into tables, and the small registries that configure them."""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..sources.relations import ranked
from . import quality, scorers, stability, statistics


def experiment(pool: DataFrame, qrels: DataFrame, scorer: str, k: int = 10) -> DataFrame:
    """trec measures of one pass of a scorer over pools in first-stage order."""
    rows = pool.withColumn("perm_idx", F.lit(0).cast("bigint")).withColumnRenamed("fs_rank", "position")
    scored = scorers.REGISTRY[scorer](rows).select("qid", "perm_idx", "docid", "position", "score")
    return quality.trec_measures(ranked(scored, "position", "docid"), qrels, k)


def presentation_study(log: DataFrame, qrels: DataFrame) -> DataFrame:
    """All per-query figures of a score log."""
    return stability.evaluate(ranked(log), qrels)


def rebuilt(shards: list[DataFrame], qrels: DataFrame, prefix: str, least: int) -> DataFrame:
    """The figures of score logs in shards, of presentations whose label has the prefix, for queries that have at least so many of them; of rows that shards repeat the one with the largest score counts."""
    log = shards[0]
    for shard in shards[1:]:
        log = log.unionByName(shard)
    keys = ["qid", "perm_idx", "docid"]
    log = log.where(F.col("label").startswith(prefix)).groupBy(*keys).agg(F.max(F.struct("score", "position")).alias("_x")).select(*keys, "_x.score", "_x.position")
    full = log.groupBy("qid").agg(F.count_distinct("perm_idx").alias("_k")).where(F.col("_k") >= least).select("qid")
    return presentation_study(log.join(full, "qid", "left_semi").select("qid", "perm_idx", "docid", "position", "score"), qrels)


def geometry(configs: DataFrame) -> DataFrame:
    """(id, context, width) of a scorer class: what is in the prompt with a document, and how many documents."""
    context = F.when(F.col("family").isin("pointwise"), "document").when(F.col("family") == "pairwise", "pair").when(F.col("width") >= F.col("depth"), "pool").otherwise("chunk")
    width = F.when(context == "document", 1).when(context == "pair", 2).when(context == "pool", F.col("depth")).otherwise(F.col("width"))
    return configs.select("id", context.alias("context"), width.cast("bigint").alias("context_width"))


#: Analyses by name.
ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "tau-psi": lambda log: stability.mean_tau(ranked(log)).withColumn("tau_psi", stability.tau_psi(F.col("tau"))),
    "bootstrap-ci": statistics.poisson_bootstrap,
    "gain-histogram": statistics.gain_histogram,
    "calibration": statistics.clustered_ols,
    "distribution": statistics.distribution,
}


def analysis(name: str, *args, **kwargs) -> DataFrame:
    if name not in ANALYSES:
        raise KeyError(f"no analysis {name}; there are {', '.join(sorted(ANALYSES))}")
    return ANALYSES[name](*args, **kwargs)


def checked(values: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, value, ok): named values against (name, target, tolerance); a name without a value is not ok."""
    both = expected.join(values, "name", "left")
    return both.select("name", "value", F.coalesce((F.abs(F.col("value") - F.col("target")) <= F.col("tolerance")), F.lit(False)).cast("bigint").alias("ok"))


def overridden(config: dict, *overrides: str) -> dict:
    """A nested configuration after `a.b.c=value` overrides; values are read as JSON where they are; an override may not go through a value."""
    import json

    out = deepcopy(config)
    for item in overrides:
        path, found, raw = item.partition("=")
        if not found:
            raise ValueError(f"{item} has no value")
        at, node = path.split("."), out
        for part in at[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path} goes through a value")
        try:
            node[at[-1]] = json.loads(raw)
        except ValueError:
            node[at[-1]] = raw
    return out


def merged(*configs: dict) -> dict:
    """Later configurations over earlier ones, key by key."""
    out: dict = {}
    for config in configs:
        for k, v in config.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def flattened(config: dict, prefix: str = "") -> dict:
    out: dict = {}
    for k, v in config.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


#: Prompt templates: what a document's prompt is, as a column of text columns.
TEMPLATES: dict[str, Callable[[Column, Column], Column]] = {
    "grade": lambda query, text: F.concat(F.lit("Query: "), query, F.lit("\nDocument: "), text, F.lit("\nGrade (0-3):")),
    "yes_no": lambda query, text: F.concat(F.lit("Does the document answer the query?\n"), query, F.lit("\n"), text, F.lit("\nyes or no:")),
}


def echo(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """A reader that answers with the last line of its prompt: for tests of what surrounds a reader."""
    return prompts.withColumn("prediction", F.element_at(F.split(prompt, "\n"), -1))


def retriever(name: Column) -> Column:
    """The first stage that a run's name tells."""
    low = F.lower(name)
    return F.when(low.contains("bm25"), "bm25").when(low.rlike("splade|sparse"), "sparse").when(low.rlike("bge|dense|contriever"), "dense").otherwise("unknown")


def headline_and_detail(per_query: DataFrame, measures: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """Writes per-query rows as JSON lines and their aggregate as CSV with a header; gives both as stored."""
    per_query.write.json(f"{path}/detail")
    quality.over_queries(per_query, measures).coalesce(1).write.option("header", True).csv(f"{path}/headline")
    spark = per_query.sparkSession
    return spark.read.schema("measure string, mean double, std double, n bigint").option("header", True).csv(f"{path}/headline"), spark.read.schema(per_query.schema).json(f"{path}/detail")


def materialized(records: DataFrame, query: Column, options: Column, gold: Column) -> dict[str, DataFrame]:
    """Topics, judgments and a run from records that hold a query, an array of options and the place of the right one: what dataset setups have in common."""
    rows = records.select(F.col("id").cast("string").alias("qid"), query.alias("query"), gold.alias("_g"), F.posexplode(options).alias("rank", "text"))
    docid = F.concat_ws("-", "qid", "rank")
    return {
        "topics": rows.select("qid", "query").distinct(),
        "qrels": rows.select("qid", docid.alias("docid"), (F.col("rank") == F.col("_g")).cast("int").alias("rel")),
        "run": rows.select("qid", docid.alias("docid"), F.col("rank").cast("bigint").alias("fs_rank"), "text"),
    }


@F.pandas_udf(StringType())
def last_boxed(texts):
    r"""What the last \boxed of a text holds, without white space around it; null if there is none, or if its braces do not close. White space may stand before the brace.

    Balanced braces are beyond regular expressions, so this is an Arrow-batched function; it reads a text once, from its last \boxed on.
    """
    import re

    import pandas as pd

    opened, brace = re.compile(r"\s*\{"), re.compile(r"[{}]")

    def one(t: str | None) -> str | None:
        start = (t or "").rfind("\\boxed")
        first = opened.match(t, start + 6) if start >= 0 else None
        if not first:
            return None
        depth = 1
        for m in brace.finditer(t, first.end()):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return t[first.end() : m.start()].strip()
        return None

    return pd.Series([one(t) for t in texts])


def matched_anchors(rows: DataFrame, arm: str, anchor: list[str]) -> DataFrame:
    """(qid, n_arms, matched): whether all arms of a query have the same anchor."""
    return rows.groupBy("qid").agg(F.count_distinct(arm).alias("n_arms"), (F.count_distinct(F.struct(*anchor)) == 1).cast("bigint").alias("matched"))


def grouped_examples(labels: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, docids, scores, n_missing): a query's labels in pool order, and how many of its pool have none; a total join has none missing."""
    both = pool.join(labels, ["qid", "docid"], "full_outer")
    ordered = F.array_sort(F.collect_list(F.when(F.col("fs_rank").isNotNull() & F.col("score").isNotNull(), F.struct("fs_rank", "docid", "score"))))
    out = both.groupBy("qid").agg(ordered.alias("x"), F.count(F.when(F.col("score").isNull() | F.col("fs_rank").isNull(), 1)).alias("n_missing"))
    return out.select("qid", F.transform("x", lambda v: v["docid"]).alias("docids"), F.transform("x", lambda v: v["score"]).alias("scores"), "n_missing")


def collected(plan: DataFrame, runs: DataFrame, key: str, time: str) -> DataFrame:
    """Planned cells with their latest run and whether they are ready."""
    last = runs.groupBy(key).agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), time).alias("_r"))
    return plan.join(last, key, "left").select(*plan.columns, F.col("_r").isNotNull().cast("bigint").alias("ready"), "_r.*")


def table_rows(cells: DataFrame, rows: str, columns: list[str], column: str, value: str) -> DataFrame:
    """A paper table: a row for each value of `rows`, a column for each of `columns`, and whether the row is full."""
    p = cells.groupBy(rows).pivot(column, columns).agg(F.avg(value))
    full = F.lit(True)
    for c in columns:
        full = full & F.col(f"`{c}`").isNotNull()
    return p.withColumn("complete", full.cast("bigint"))


def converged_best(rows: DataFrame, least_step: int) -> DataFrame:
    """(lam, best, step): the best metric of each lam from a step on, the earliest of equal ones."""
    order = Window.partitionBy("lam").orderBy(F.desc("metric"), "step")
    return rows.where(F.col("step") >= least_step).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("lam", F.col("metric").alias("best"), "step")

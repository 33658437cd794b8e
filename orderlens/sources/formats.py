"""Sources and sinks: judgments, runs, topics, fixtures, score logs, labels, sidecars and catalogs.

Text formats are read with spark.read.text and taken apart by column expressions, so that reading splits by file and block and writing commits by task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import scratch

SCORE_LOG = "checkpoint string, recipe string, query_id string, perm_idx int, doc_id string, position int, score double, permutation_label string, seed int"
SILVER = "query_id string, doc_id string, score_continuous double, score_raw_vector array<double>, score_grade_vector array<double>, k_perms int, teacher string, created_at string, extra map<string,string>"
FIXTURE = "qid string, query string, passages array<struct<pid:string,text:string>>"


def fields(spark: SparkSession, path: str) -> DataFrame:
    """value's white-space separated fields f, and line: an order of lines that follows the names of files, the blocks in a file and the lines in a block, whichever task reads them."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select(at.alias("line"), F.split(F.trim("value"), r"\s+").alias("f"))


def last_wins(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, "line").alias(value))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rel) of `qid _ docid rel` lines; shorter lines are dropped, of repeated keys the last counts."""
    rows = fields(spark, path).where(F.size("f") >= 4)
    return last_wins(rows.select("line", F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.col("f")[3].try_cast("int").alias("rel")).where("rel is not null"), ["qid", "docid"], "rel")


def judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """Every query that has a judgment, whatever it says."""
    return fields(spark, path).where(F.size("f") >= 4).select(F.col("f")[0].alias("qid")).distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rank, score, tag, bad) of `qid Q0 docid rank score tag` lines; bad marks short lines and ranks that are no number."""
    rows = fields(spark, path)
    at = lambda i: F.get("f", F.lit(i))
    rank = at(3).try_cast("int")
    return rows.select("line", at(0).alias("qid"), at(2).alias("docid"), rank.alias("rank"), at(4).try_cast("double").alias("score"), at(5).alias("tag"), ((F.size("f") < 6) | rank.isNull()).alias("bad"))


def run_lines(ranking: DataFrame, tag: str) -> DataFrame:
    """(qid, rank, value): TREC lines of (qid, docid, rnk, score); raw scores if they strictly fall within the query, else n - rank."""
    w = Window.partitionBy("qid")
    falls = F.coalesce(F.lag("score").over(w.orderBy("rnk")) > F.col("score"), F.lit(True))
    rows = ranking.withColumn("_falls", falls).withColumn("_ok", F.bool_and("_falls").over(w)).withColumn("_n", F.count("*").over(w))
    score = F.when(F.col("_ok"), F.col("score").cast("string")).otherwise((F.col("_n") - F.col("rnk")).cast("double").cast("string"))
    return rows.select("qid", (F.col("rnk") + 1).alias("rank"), F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("docid").cast("string"), (F.col("rnk") + 1).cast("string"), score, F.lit(tag)).alias("value"))


def write_run(ranking: DataFrame, path: str, tag: str) -> None:
    """Queries stay together and in order of rank; files are sorted by query."""
    run_lines(ranking, tag).repartitionByRange("qid").sortWithinPartitions("qid", "rank").select("value").write.text(path)


def sorted_run(run: DataFrame) -> DataFrame:
    """By query and rank. Ranges are of queries alone, so that no query is cut where one task's range ends and the next one's begins."""
    return run.where("not bad").repartitionByRange("qid").sortWithinPartitions("qid", "rank")


def retagged(run: DataFrame, tag: str) -> DataFrame:
    """An external run as a baseline of ours."""
    return run.where("not bad").withColumn("tag", F.lit(tag))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="qid string, text string", quote="")


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, rank, pid, text): a fixture's passages in order."""
    return spark.read.schema(FIXTURE).json(path).select("qid", "query", F.posexplode("passages").alias("rank", "p")).select("qid", "query", "rank", "p.pid", "p.text")


def fixture_of(passages: DataFrame) -> DataFrame:
    """The inverse of read_fixture()."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "pid", "text")))
    return passages.groupBy("qid", "query").agg(F.transform(ordered, lambda p: F.struct(p["pid"].alias("pid"), p["text"].alias("text"))).alias("passages"))


def with_text(run: DataFrame, docs: DataFrame, key: str, *preferred: Column) -> DataFrame:
    """A run's documents with the first of the preferred texts that they have."""
    return run.join(docs.select(F.col(key).alias("docid"), F.coalesce(*preferred).alias("text")), "docid")


def write_score_log(log: DataFrame, path: str, *by: str) -> None:
    log.write.partitionBy(*by).parquet(path) if by else log.write.parquet(path)


def read_score_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def aligned(sources: list[DataFrame]) -> DataFrame:
    """(qid, docid, scores) from the first source that has rows; of a query those presentations that all its documents have."""
    log = next((s for s in sources if not s.isEmpty()), sources[-1])
    docs = log.groupBy("qid").agg(F.count_distinct("docid").alias("_n"))
    full = log.groupBy("qid", "perm_idx").agg(F.count_distinct("docid").alias("_k")).join(docs, "qid").where("_k = _n").select("qid", "perm_idx")
    rows = log.join(full, ["qid", "perm_idx"], "left_semi")
    return rows.groupBy("qid", "docid").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm_idx", "score"))), lambda x: x["score"]).alias("scores"))


def append_silver(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").json(path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SILVER).json(path)


#: The most quantiles that ranges of lines start from, the most ranges in all, and the lines of one.
STRETCHES, RANGES, PER_RANGE = 256, 65_536, 100_000


def ranges(lines: DataFrame, line: str, per_range: int) -> Column:
    """A number for ranges of the integer line in its order, with about per_range rows each; lines without a value have -1."""
    n = lines.count()
    stretches = max(1, min(STRETCHES, n // per_range))
    edges = sorted(set(lines.agg(F.percentile_approx(line, [i / stretches for i in range(stretches + 1)], 10_000)).first()[0] or []))
    if len(edges) < 2:
        return F.when(F.col(line).isNull(), -1).otherwise(0).cast("bigint")
    each = max(1, min(RANGES, n // per_range) // (len(edges) - 1))

    def number(lo: int, hi: int) -> Column:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(F.col(line) < edges[mid], number(lo, mid)).otherwise(number(mid, hi))
        width = max(1, -(-(edges[hi] - edges[lo]) // each))
        return lo * each + F.greatest(F.lit(0), F.least(F.floor((F.col(line) - edges[lo]) / width), F.lit(each - 1)))

    return F.coalesce(number(0, len(edges) - 1), F.lit(-1)).cast("bigint")


def regrouped(lines: DataFrame, key: str, line: str, per_range: int = PER_RANGE) -> DataFrame:
    """Keys whose rows do not stand together: more changes of key than keys. Needs an integer order of lines, so it is for files of one writer.

    Rows are compared within ranges of lines, and each range's first row with the last of the range before; only these edges are brought together.
    """
    rows = lines.select(key, line).withColumn("_range", ranges(lines, line, per_range))
    at = F.struct(F.col(line), F.col(key))
    ends = rows.groupBy("_range").agg(F.max(at).alias("_last"))
    before = ends.select("_range", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_before"))
    inner = rows.withColumn("_p", F.lag(at).over(Window.partitionBy("_range").orderBy(line, key)))
    starts = inner.join(F.broadcast(before), "_range").where(~F.col(key).eqNullSafe(F.coalesce("_p", "_before")[key]))
    return starts.groupBy(key).agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def first_seen(rows: DataFrame, key: str, line: str) -> DataFrame:
    """(key, place): keys in the order in which they first occur."""
    return rows.groupBy(key).agg(F.min(line).alias("place"))


def unique_ids(ids: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once; a list must have none."""
    return ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def union_shards(shards: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def topped_up(parent: DataFrame, extra: DataFrame, key: str, n: str) -> DataFrame:
    """Of each key the parent's row if it is at least as complete, else the extra one's."""
    p, e = parent.select(key, F.struct(*[c for c in parent.columns if c != key]).alias("_p")), extra.select(key, F.struct(*[c for c in parent.columns if c != key]).alias("_e"))
    both = p.join(e, key, "full_outer")
    take = F.when(F.col(f"_p.{n}") >= F.coalesce(F.col(f"_e.{n}"), F.lit(-1)), F.col("_p")).otherwise(F.coalesce("_e", "_p"))
    return both.select(key, take.alias("x")).select(key, "x.*")


def latest_complete(catalog: DataFrame, key: str, time: str, complete: Column) -> DataFrame:
    """The latest complete artifact of each key."""
    return catalog.where(complete).groupBy(key).agg(F.max_by(F.struct(*catalog.columns), time).alias("x")).select("x.*")


def progress_events(lines: DataFrame) -> DataFrame:
    """(step, metric) of the evaluation events in JSON lines."""
    schema = "event string, step bigint, metric double"
    return lines.select(F.from_json("value", schema).alias("e")).where("e.event = 'eval'").select("e.step", "e.metric")


#: The most queries that are broadcast at once.
BLOCK = 10_000


def dense_top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(qid, docid, score, rank): exact inner products of queries against all vectors; each task keeps its own best k first.

    Up to `block` queries are broadcast. Of more, blocks of about half as many are searched one after the other, each written before the next is begun.
    """
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")

    def search(some: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("_q", vector, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        rows = vectors.join(F.broadcast(some.select(F.col(key).alias("qid"), F.col(vector).alias("_q")))).select("qid", F.col(key).alias("docid"), F.round(dot, 6).alias("score"))
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    n = queries.count()
    if n <= block:
        return search(queries)
    blocks = -(-2 * n // block)
    path = scratch(queries.sparkSession, "dense")
    for i in range(blocks):
        search(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)).write.mode("append").parquet(path)
    return queries.sparkSession.read.parquet(path)


#: The most words of all queries that are broadcast.
ASKED = 1_000_000


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int, k1: float = 0.9, b: float = 0.4, most: int = ASKED) -> DataFrame:
    """(qid, docid, score, rank): lexical first stage over (qid, query) for lower-case words; only query words are kept of the documents.

    Documents' words are shuffled once, by document, where their scores are summed and each task keeps its own best k. Queries of more than `most` words in all are joined by shuffles.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = queries.select("qid", F.explode(F.array_distinct(words(F.col("query")))).alias("w"))
    known = F.broadcast if asked.limit(most + 1).count() <= most else lambda df: df
    terms = docs.select(F.col(key).alias("docid"), words(F.col(text)).alias("_w")).withColumn("n", F.size("_w"))
    sizes = terms.agg(F.count("*").alias("all"), F.avg("n").alias("mean"))
    hits = terms.select("docid", "n", F.explode("_w").alias("w")).join(known(asked.select("w").distinct()), "w", "left_semi").repartition("docid").groupBy("docid", "n", "w").agg(F.count("*").alias("tf"))
    idf = hits.groupBy("w").agg(F.count("*").alias("df"))
    part = F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    parts = hits.join(known(idf), "w").join(F.broadcast(sizes)).select("docid", "w", part.alias("_part"))
    total = parts.join(known(asked), "w").groupBy("qid", "docid").agg(F.round(F.sum("_part"), 6).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))).where(F.col("rank") <= k)

"""Joins, filters, set operations, windows and sorts that rankings need: strict pairings, allowlists, gates, schedules and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# filters
def finite(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a number: neither null nor NaN nor infinite."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def strict_qrels(candidates: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidates of queries with a judgment."""
    return candidates.join(qrels.select("qid").distinct(), "qid", "left_semi")


def allowlisted(rows: DataFrame, *lists: DataFrame, key: str = "qid") -> DataFrame:
    """Rows whose key stands in any of the lists."""
    allowed = lists[0].select(key)
    for more in lists[1:]:
        allowed = allowed.unionByName(more.select(key))
    return rows.join(allowed.distinct(), key, "left_semi")


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def with_presentations(log: DataFrame, least: int) -> DataFrame:
    """Rows of queries with at least so many presentations."""
    full = log.groupBy("qid").agg(F.count_distinct("perm_idx").alias("_k")).where(F.col("_k") >= least)
    return log.join(full.select("qid"), "qid", "left_semi")


def restricted(ranking: DataFrame, kept: DataFrame) -> DataFrame:
    """Rankings of kept (qid, docid) only, ranks closed up; complete is 0 for a query that lacks one of its kept documents."""
    rows = ranking.join(kept.select("qid", "docid"), ["qid", "docid"])
    n = kept.groupBy("qid").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("qid", "perm_idx")
    rows = rows.withColumn("rnk", (F.row_number().over(w.orderBy("rnk")) - 1).cast("bigint")).withColumn("_k", F.count("*").over(w)).join(n, "qid")
    return rows.withColumn("complete", (F.col("_k") == F.col("_n")).cast("bigint")).drop("_k", "_n")


def fully_covered(rows: DataFrame, key: str, bad: Column, least: int) -> DataFrame:
    """(key, n, clean): rows without an error of each key, and whether there are enough."""
    return rows.where(~bad).groupBy(key).agg(F.count("*").alias("n")).withColumn("clean", (F.col("n") >= least).cast("bigint"))


def sliced_labels(rows: DataFrame, start: int, k: int) -> DataFrame:
    """(query_id, doc_id, score, k): labels from k raw scores from start on, for documents that have them all."""
    part = rows.where((F.col("k") >= start) & (F.col("k") < start + k))
    return part.groupBy("query_id", "doc_id").agg(F.avg("score").alias("score"), F.count("*").alias("k")).where(F.col("k") == k)


# joins
def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, difference): a strict pairing, in which jointly missing or not-a-number values are left out; see unpaired()."""
    left, right = a.select(*keys, F.nanvl(value, F.lit(None).cast("double")).alias("_x")), b.select(*keys, F.nanvl(value, F.lit(None).cast("double")).alias("_y"))
    return left.join(right, keys).where("_x is not null and _y is not null").select(*keys, (F.col("_x") - F.col("_y")).alias("difference"))


def unpaired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one side; a strict pairing has none."""
    left, right = a.select(*keys).distinct().withColumn("_l", F.lit(1)), b.select(*keys).distinct().withColumn("_r", F.lit(1))
    return left.join(right, keys, "full_outer").where("_l is null or _r is null").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def common(rows: DataFrame, arm: str, arms: int) -> DataFrame:
    """Queries that every arm has."""
    return rows.groupBy("qid").agg(F.count_distinct(arm).alias("_n")).where(F.col("_n") == arms).select("qid")


def ordered_pairs(rows: DataFrame) -> DataFrame:
    a, b = (rows.select("qid", F.col("docid").alias(x)) for x in "ab")
    return a.join(b, "qid").where("a <> b")


def nearest_donors(rows: DataFrame, key: str, length: str, owner: str) -> DataFrame:
    """(key, donor, gap): of another owner's rows, one whose length is nearest, whatever the gap; ties by a hash of both ids.

    Rows meet a table with a row for each length that occurs: there stand two donors of that length of different owners, and the nearest ones below and above, each again
    with one of another owner. So no two rows are compared, however many share a length. That table is as large as there are different lengths; windows go over it as a
    whole. Rows without an owner or a length neither have nor are donors; without a second owner there is no donor.
    """
    given = rows.select(F.col(key).alias("k"), F.col(owner).alias("o"), F.col(length).alias("l")).where("o is not null and l is not null")
    each = given.groupBy("l", "o").agg(F.min("k").alias("k"))
    one = each.groupBy("l").agg(F.min(F.struct("k", "o")).alias("a"))
    two = each.join(one.withColumnRenamed("l", "_l"), (F.col("l") == F.col("_l")) & (F.col("o") != F.col("a.o"))).groupBy(F.col("l").alias("_l")).agg(F.min(F.struct("k", "o")).alias("b"))
    table = one.join(two, F.col("l") == F.col("_l"), "left")
    donor = lambda c: F.struct(F.col(f"{c}.k").alias("k"), F.col(f"{c}.o").alias("o"), F.col("l").alias("l"))
    table = table.select("l", donor("a").alias("a"), F.when(F.col("b").isNotNull(), donor("b")).alias("b"))
    for side, order in (("below", F.col("l").asc()), ("above", F.col("l").desc())):
        w = Window.partitionBy(F.lit(0)).orderBy(order)
        before = F.lag("a").over(w)
        turn = F.when(F.col("b").isNotNull(), F.col("b")).when(before["o"] != F.col("a.o"), before)
        table = table.withColumn(f"_{side}", turn).withColumn(side, F.last(f"_{side}", ignorenulls=True).over(w)).drop(f"_{side}")
    met = given.join(table.withColumnRenamed("l", "_l"), F.col("l") == F.col("_l"))
    choice = F.array(F.col("a"), F.col("b"), F.col("below"), F.col("above"))
    ranked = F.transform(F.filter(choice, lambda x: x.isNotNull() & (x["o"] != F.col("o"))), lambda x: F.struct(F.abs(x["l"] - F.col("l")).alias("gap"), F.xxhash64(F.col("k"), x["k"]).alias("h"), x["k"].alias("donor")))
    return met.select(F.col("k").alias(key), F.array_min(ranked).alias("d")).where("d is not null").select(key, "d.donor", "d.gap")


def overlay(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with the fields of new where those are given."""
    n = new.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return old.join(n, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in old.columns))


def missing(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return declared.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def shard_check(rows: DataFrame, shard: str, index: str) -> DataFrame:
    """One row: rows, distinct indices, repeated ones, and whether they are 0 to n-1."""
    per = rows.groupBy(index).agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count("*").alias("distinct_n"), F.count(F.when(F.col("c") > 1, 1)).alias("repeated"), ((F.min(index) == 0) & (F.max(index) == F.count("*") - 1)).cast("bigint").alias("complete"))


# windows
def chunked(rows: DataFrame, n: str, width: int, round_robin: bool) -> Column:
    """The chunk of a 0-based rank: contiguous, or dealt out in turn."""
    chunks = F.ceil(F.col(n) / width)
    return (F.col("fs_rank") % chunks) if round_robin else F.floor(F.col("fs_rank") / width)


def sliding_windows(n: Column, width: int, stride: int) -> Column:
    """Starts of list windows from the end of n items to the front, the last one at 0."""
    steps = F.when(n > width, F.array_union(F.transform(F.sequence(F.lit(0), F.floor((n - width) / stride).cast("int")), lambda i: (n - width - i * stride).cast("int")), F.array(F.lit(0)))).otherwise(F.array(F.lit(0)))
    return steps


def stratified(rows: DataFrame, keep: int, mid: int, n_mid: int, n_deep: int) -> DataFrame:
    """The first `keep` ranks, n_mid of those up to mid, n_deep of the rest, drawn by a hash of query and document."""
    band = F.when(F.col("fs_rank") < keep, 0).when(F.col("fs_rank") < mid, 1).otherwise(2)
    order = F.md5(F.concat_ws(":", "qid", "docid"))
    ranked = rows.withColumn("band", band).withColumn("_r", F.row_number().over(Window.partitionBy("qid", "band").orderBy(order)))
    return ranked.where((F.col("band") == 0) | ((F.col("band") == 1) & (F.col("_r") <= n_mid)) | ((F.col("band") == 2) & (F.col("_r") <= n_deep))).drop("_r")


def warmup(step: Column, steps: int, lam: float) -> Column:
    return F.least(F.lit(lam), lam * step / steps)


def quantile_map(source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """source with the i-th smallest value replaced by the target's i-th smallest, within key."""
    w = Window.partitionBy(key)
    a = source.withColumn("_i", F.row_number().over(w.orderBy(value, "docid")))
    b = target.withColumn("_i", F.row_number().over(w.orderBy(value, "docid"))).select(key, "_i", F.col(value).alias("mapped"))
    return a.join(b, [key, "_i"]).drop("_i")


def inverse(ranking: DataFrame) -> DataFrame:
    """(qid, perm_idx, rnk, position): where what now has a rank stood before."""
    return ranking.select("qid", "perm_idx", "rnk", "position")


def strongest_positive(candidates: DataFrame, qrels: DataFrame) -> DataFrame:
    rows = candidates.join(qrels.where("rel > 0"), ["qid", "docid"])
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "docid"))).where("_r = 1").drop("_r")


# sets
def split_by_rank(keys: DataFrame, key: str, held: int) -> DataFrame:
    """Keys with held: 1 for the `held` of them with the greatest hash."""
    ranked = keys.select(key).distinct().withColumn("_h", F.md5(F.col(key).cast("string")))
    cut = ranked.orderBy(F.desc("_h"), key).limit(held).select(key, F.lit(1).alias("held"))
    return ranked.join(F.broadcast(cut), key, "left").select(key, F.coalesce("held", F.lit(0)).alias("held"))


def derangement(rows: DataFrame) -> DataFrame:
    """(qid, docid, other): each document paired with the next of its query by id, the last with the first; nobody with itself if there are two."""
    w = Window.partitionBy("qid").orderBy("docid")
    first = F.first("docid").over(Window.partitionBy("qid").orderBy("docid"))
    return rows.select("qid", "docid", F.coalesce(F.lead("docid").over(w), first).alias("other"))

"""Pool, width, context and variance decompositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stability import tau_psi


def fixed_pools(candidates: DataFrame, depth: int = 100) -> DataFrame:
    """(qid, docid, arm, rank) of the canonical pool, one with a candidate dropped, and one with that replaced by the next; the dropped rank is the query id modulo the pool's size."""
    rows = candidates.where(F.col("fs_rank") <= depth)
    n = F.sum((F.col("fs_rank") < depth).cast("int")).over(Window.partitionBy("qid"))
    rows = rows.withColumn("_drop", F.pmod(F.col("qid"), n))
    arms = F.when(F.col("fs_rank") == depth, F.array(F.lit("replace"))).when(F.col("fs_rank") == F.col("_drop"), F.array(F.lit("canonical"))).otherwise(F.array(F.lit("canonical"), F.lit("drop"), F.lit("replace")))
    rows = rows.withColumn("arm", F.explode(arms)).withColumn("_r", F.when(F.col("fs_rank") == depth, F.col("_drop")).otherwise(F.col("fs_rank")))
    order = Window.partitionBy("qid", "arm").orderBy("_r")
    return rows.select("qid", "docid", "arm", (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


def pool_change(rankings: DataFrame, k: int = 10) -> DataFrame:
    """(qid, arm, n_common, tau, pool_psi, top_changed) of each other arm against the canonical one, on common documents."""
    base = rankings.where("arm = 'canonical'").select("qid", "docid", F.col("rnk").alias("ra"))
    other = rankings.where("arm <> 'canonical'").select("qid", "docid", "arm", F.col("rnk").alias("rb"))
    both = other.join(base, ["qid", "docid"])
    left, right = (both.select("qid", "arm", F.col("ra").alias(f"ra_{x}"), F.col("rb").alias(f"rb_{x}")) for x in "xy")
    pairs = left.join(right, ["qid", "arm"]).where("ra_x < ra_y").groupBy("qid", "arm").agg(F.avg(F.when(F.col("rb_x") < F.col("rb_y"), 1.0).otherwise(-1.0)).alias("tau"))
    tops = both.groupBy("qid", "arm").agg(F.count("*").alias("n_common"), F.max(((F.col("ra") < k) != (F.col("rb") < k)).cast("int")).alias("moved"))
    out = tops.join(pairs, ["qid", "arm"], "left")
    return out.select("qid", "arm", "n_common", "tau", tau_psi(F.col("tau")).alias("pool_psi"), F.col("moved").alias("top_changed"))


def digest(rows: DataFrame, *by: str) -> DataFrame:
    """(by, digest): the first 16 hex digits of the SHA-256 of the sorted members, one a line."""
    members = F.array_join(F.array_sort(F.collect_list(F.col("docid").cast("string"))), "\n")
    return rows.groupBy(*by).agg(F.substring(F.sha2(members, 256), 1, 16).alias("digest"))


def four_arms(values: DataFrame) -> DataFrame:
    """(qid, width, scaffold, presence, content, closure) from (qid, arm, value) with arms 1 to 4: A2-A1 = (A2-A3) + (A3-A4) + (A4-A1), with shares of the width, null if that is 0."""
    p = values.groupBy("qid").pivot("arm", [1, 2, 3, 4]).agg(F.avg("value"))
    a = {i: F.col(str(i)) for i in (1, 2, 3, 4)}
    out = p.select("qid", (a[2] - a[1]).alias("width"), (a[2] - a[3]).alias("content"), (a[3] - a[4]).alias("presence"), (a[4] - a[1]).alias("scaffold"))
    return out.withColumn("closure", F.col("width") - F.col("content") - F.col("presence") - F.col("scaffold")).withColumn("content_share", F.when(F.col("width") != 0, F.col("content") / F.col("width")))


def score_effects(log: DataFrame, base: int, other: int) -> DataFrame:
    """(qid, effect, absolute, n): mean signed and absolute change of documents' scores between two presentations."""
    a = log.where(F.col("perm_idx") == base).select("qid", "docid", F.col("score").alias("a"))
    b = log.where(F.col("perm_idx") == other).select("qid", "docid", F.col("score").alias("b"))
    return a.join(b, ["qid", "docid"]).groupBy("qid").agg(F.avg(F.col("b") - F.col("a")).alias("effect"), F.avg(F.abs(F.col("b") - F.col("a"))).alias("absolute"), F.count("*").alias("n"))


def nearest_rank(histogram: DataFrame, value: str, n: str, share: float) -> DataFrame:
    """One row: the least value at which the cumulative count reaches the share; the histogram is small."""
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))
    cumulative = F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(value))
    return histogram.withColumn("_c", cumulative).withColumn("_t", total).where(F.col("_c") >= F.ceil(F.col("_t") * share)).agg(F.min(value).alias("value"))


def slots(log: DataFrame, width: int) -> DataFrame:
    """The log with slot (place in its chunk) and chunk of each position."""
    return log.withColumn("slot", F.col("position") % width).withColumn("chunk", F.floor(F.col("position") / width))


COMPONENTS = "qid bigint, n bigint, total double, document double, slot double, chunk double, residual double"


def fixed_effects(rows: DataFrame) -> DataFrame:
    """Per query, of score ~ document + slot + chunk: the total variance and what nested least-squares fits explain; rows without a score are left out.

    Documents are taken out by their means, which leaves normal equations as small as the number of slots and chunks. Queries come as one row each, in Arrow batches.
    """
    from collections.abc import Iterator

    import pandas as pd

    names = [c.split(" ")[0] for c in COMPONENTS.split(", ")]

    def explained(doc, y, columns):
        """What dummies of the columns explain of the sum of squares within documents."""
        import numpy as np

        codes = [np.unique(c, return_inverse=True)[1] for c in columns]
        widths = [int(c.max()) + 1 for c in codes]
        n, p = int(doc.max()) + 1, sum(widths)
        starts = np.cumsum([0, *widths[:-1]])
        cells, gram, b = np.zeros((n, p)), np.zeros((p, p)), np.zeros(p)
        for c, s in zip(codes, starts, strict=True):
            np.add.at(cells, (doc, c + s), 1.0)
            np.add.at(b, c + s, y)
            for d, r in zip(codes, starts, strict=True):
                np.add.at(gram, (c + s, d + r), 1.0)
        gram -= cells.T @ (cells / np.bincount(doc, minlength=n)[:, None])
        return float(b @ np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ b)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            out = []
            for qid, docs, slot, chunk, score in batch.itertuples(index=False, name=None):
                y = np.asarray(score, float)
                doc = np.unique(docs, return_inverse=True)[1]
                within = y - (np.bincount(doc, y) / np.bincount(doc))[doc]
                total, left = float(y.var()), float(within @ within) / len(y)
                one, two = (explained(doc, within, columns) / len(y) for columns in ([slot], [slot, chunk]))
                out.append((qid, len(y), total, total - left, one, two - one, left - two))
            yield pd.DataFrame(out, columns=names)

    columns = ["docid", "slot", "chunk", "score"]
    per = rows.where("score is not null").groupBy("qid").agg(*(F.collect_list(c).alias(c) for c in columns))
    return per.mapInPandas(solve, COMPONENTS)


def document_effect(rows: DataFrame) -> DataFrame:
    """(qid, total, document, rest): the document part of fixed_effects alone, which needs no solver."""
    return rows.withColumn("_m", F.avg("score").over(Window.partitionBy("qid", "docid"))).groupBy("qid").agg(F.var_pop("score").alias("total"), F.var_pop("_m").alias("document"), F.avg(F.pow(F.col("score") - F.col("_m"), 2)).alias("rest"))


def shares(components: DataFrame, *by: str) -> DataFrame:
    """Sums of components and each one's share of what is left beside documents; null if nothing is."""
    names = ["slot", "chunk", "residual"]
    sums = components.groupBy(*by).agg(*(F.sum(c).alias(c) for c in [*names, "total"]), F.count("*").alias("n"))
    rest = F.col("slot") + F.col("chunk") + F.col("residual")
    return sums.select(*by, "n", (rest / F.col("total")).alias("pooled"), *(F.when(rest > 0, F.col(c) / rest).alias(f"{c}_share") for c in names))


def copresence(log: DataFrame) -> DataFrame:
    """Per query, of c = mean over presentations less the canonical score: mean, variance, the part that is one offset for all documents, the correlation of both scores, pooled deviation."""
    per = log.groupBy("qid", "docid").agg(F.avg(F.when(F.col("perm_idx") > 0, F.col("score"))).alias("wide"), F.max(F.when(F.col("perm_idx") == 0, F.col("score"))).alias("alone"))
    per = per.where("wide is not null and alone is not null").withColumn("c", F.col("wide") - F.col("alone"))
    return per.groupBy("qid").agg(
        F.count("*").alias("n"), F.avg("c").alias("offset"), F.var_pop("c").alias("residual_variance"), F.when((F.var_pop("wide") > 0) & (F.var_pop("alone") > 0), F.corr("wide", "alone")).alias("corr"),
        F.sqrt((F.var_pop("wide") + F.var_pop("alone")) / 2).alias("pooled_sd"),
    )


def balanced(rows: DataFrame, value: str, group: str = "dataset") -> DataFrame:
    """One row: mean and deviation of a value with each group weighing the same."""
    n = F.count("*").over(Window.partitionBy(group))
    groups = rows.select(F.count_distinct(group).alias("_d"))
    w = rows.withColumn("_n", n).join(F.broadcast(groups)).withColumn("_w", 1 / (F.col("_d") * F.col("_n")))
    agg = w.agg(F.sum(F.col("_w") * F.col(value)).alias("mean"), F.sum(F.col("_w") * F.col(value) * F.col(value)).alias("square"))
    return agg.select("mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("sd"))


def coverage(log: DataFrame) -> DataFrame:
    """Per query: presentations, documents, rows, and whether each document stands once in each presentation at each position."""
    agg = log.groupBy("qid").agg(
        F.count_distinct("perm_idx").alias("perms"), F.count_distinct("docid").alias("docs"), F.count("*").alias("n"),
        F.count_distinct("perm_idx", "docid").alias("keys"), F.count_distinct("perm_idx", "position").alias("places"), F.max("position").alias("last"),
    )
    full = (F.col("n") == F.col("perms") * F.col("docs")) & (F.col("keys") == F.col("n")) & (F.col("places") == F.col("n")) & (F.col("last") == F.col("docs") - 1)
    return agg.select("qid", "perms", "docs", "n", full.cast("bigint").alias("complete"))


def matched_variance(ndcg: DataFrame, averaged: DataFrame) -> DataFrame:
    """Per query: the order-averaged nDCG, mean, variance and range of the single presentations' nDCG."""
    one = ndcg.groupBy("qid").agg(F.avg("ndcg").alias("single"), F.var_pop("ndcg").alias("variance"), (F.max("ndcg") - F.min("ndcg")).alias("extent"))
    return one.join(averaged.select("qid", F.col("ndcg").alias("averaged")), "qid")


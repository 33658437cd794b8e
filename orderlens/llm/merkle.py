"""Document fingerprints: Merkle trees over pieces, paragraphs and sections.

A text's leaves are short pieces that end at sentence ends, paragraphs are lines, and a section ends with a paragraph whose own hash says so, so that an insertion moves
no later boundary. A fingerprint is `root|section/section/...`, a section `hash:paragraph,paragraph,...`, a paragraph `hash.leaf leaf ...` (hashes of 8 hex digits). The
root is a SHA-256 over the whole text's SHA-256 and the tree. Equal roots mean equal texts; where roots differ, the branches that differ locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

#: A leaf: up to 48 characters of a sentence with the stops that follow, or stops alone.
PIECE = r"[^.!?\n]{1,48}[.!?\n]*|[.!?\n]+"
NODE = "[0-9a-f]{8}"


def short(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column without nulls; an empty text has the tree of one empty paragraph."""
    leaves = F.transform(F.split(text, r"(?<=\n)", -1), lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), short), ""))
    # a paragraph ends its section for one hash in sixteen; the empty string after a final line break is no paragraph of its own but does no harm
    paragraphs = F.transform(leaves, lambda x: F.concat(short(x), F.lit("."), x, F.when(F.substring(F.sha2(x, 256), -1, 1) == "0", "/").otherwise(",")))
    tree = F.array_join(F.transform(F.split(F.array_join(paragraphs, ""), "/"), lambda s: F.concat(short(s), F.lit(":"), s)), "/")
    return F.element_at(F.transform(F.array(tree), lambda t: F.concat(F.sha2(F.concat(F.sha2(text, 256), t), 256), F.lit("|"), t)), 1)


def nodes(fingerprint: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring(fingerprint, 66, 2**31 - 1), F.lit(NODE), F.lit(0)))


def likeness(one: Column, other: Column) -> Column:
    """Of two fingerprints: twice the nodes that both have, by the nodes of each; 1 for equal roots, below 1 otherwise."""
    common = lambda p: 2.0 * F.size(F.array_intersect(p["a"], p["b"])) / (F.size(p["a"]) + F.size(p["b"]))
    part = F.element_at(F.transform(F.array(F.struct(nodes(one).alias("a"), nodes(other).alias("b"))), common), 1)
    return F.when(F.substring(one, 1, 64) == F.substring(other, 1, 64), 1.0).otherwise(F.least(F.coalesce(part, F.lit(0.0)), F.lit(0.999999)))


def differing(one: Column, other: Column) -> Column:
    """Numbers (from 0) of the first fingerprint's sections that the second does not have: where it was edited."""
    sections = lambda f: F.split(F.substring(f, 66, 2**31 - 1), "/")
    numbered = F.transform(sections(one), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return F.transform(F.filter(numbered, lambda x: ~F.array_contains(sections(other), x["s"])), lambda x: x["i"])


#: Ranges of ids of about equal numbers of rows, and the most ranges that all of them are cut into.
STRETCHES, RANGES = 32, 65_536


def ranges(docs: DataFrame, key: str, per_range: int) -> tuple[Column, int]:
    """A column that numbers ranges of the integer key in its order, with about per_range rows each, and the number of rows."""
    found = docs.agg(F.count("*").alias("n"), F.percentile_approx(key, [i / STRETCHES for i in range(STRETCHES + 1)], 2000).alias("q")).first()
    if not found.n or not found.q:
        return F.lit(0).cast("bigint"), found.n
    edges = sorted({*found.q})
    each = max(1, min(RANGES, found.n // per_range) // max(1, len(edges) - 1))
    column = F.lit(0).cast("bigint")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        width = max(1, -(-(b - a) // each))
        column = F.when(F.col(key) >= a, i * each + F.least((F.col(key) - a).cast("bigint") / width, F.lit(each - 1)).cast("bigint")).otherwise(column)
    return column, found.n


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", per_range: int = 1000) -> DataFrame:
    """key, columns, and next_<column> of the row that follows by key (after the last: the first).

    The first row of each range of keys (at most RANGES rows, broadcast) is dealt to the range before it as well; within a range a window looks one row ahead. So each
    row is shuffled once and no task holds more than a range. Rows with equal keys follow each other by the columns' order.
    """
    number, n = ranges(docs, key, per_range)
    rows = docs.select(key, *columns).withColumn("_range", number)
    firsts = rows.groupBy("_range").agg(F.min(key).alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = firsts.select("_first", F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy(F.lit(0)))).alias("_before"))
    dealt = rows.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_first")), "left")
    both = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("extra")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("extra")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("extra"))))
    dealt = dealt.select(key, *columns, F.explode(both).alias("_d")).select(key, *columns, F.col("_d.r").alias("_range"), F.col("_d.extra").alias("_extra"))
    window = Window.partitionBy("_range").orderBy("_extra", key, *columns)
    return dealt.select(key, *columns, "_extra", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns)).where("not _extra").drop("_extra")

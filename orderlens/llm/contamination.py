"""Benchmark decontamination by winnowing.

Words are hashed to grams of GRAM words; of each window of WINDOW words the least gram hash is the window's fingerprint. An item and a document that share a window share
its fingerprint, so a test against the items' fingerprints loses no window, and every shared span of WINDOW words or more is found. Windows that pass it are compared word
by word with the items' windows; hits are the union of the words of equal windows, so they extend over the whole shared span. Items of fewer words are one window each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM = 10, 5
#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items with up to so many windows are tested by a bit table and broadcast; more are joined by shuffles.
TABLE_WINDOWS = 131_072


def words(text: Column) -> Column:
    """The words of a text, each byte of it taken for one Latin-1 character. Lower-casing then changes A-Z and the first bytes of some characters; no two texts become one, as a character's length still tells such first bytes apart."""
    return F.regexp_extract_all(F.lower(F.decode(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), "ISO-8859-1")), F.lit(WORD), F.lit(0))


def gram_hashes(hashes: Column, n: Column, size: int) -> Column:
    """At each word the hash of the gram that begins there, null where none does."""
    return F.transform(hashes, lambda x, i: F.when(i <= n - size, F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, size)))))


def window_minima(grams: Column, n: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """At each word the least gram hash of the window that begins there, null where none does."""
    return F.transform(grams, lambda x, i: F.when(i <= n - window, F.least(x, *(F.get(grams, i + k) for k in range(1, window - gram + 1)))))


def bit_table(values: list[int]) -> tuple[Column, int]:
    """A table with a bit for each value, as an array of longs, and the number of longs (a power of 2): of other values less than one in sixty hits."""
    longs = 1
    while longs < len(values):
        longs *= 2
    cells = [0] * longs
    for v in values:
        cells[(v >> 6) & (longs - 1)] |= 1 << (v & 63)
    return F.split(F.lit(",".join(str(c - (1 << 64) if c >> 63 else c) for c in cells)), ",").cast("array<bigint>"), longs


def in_table(v: Column, cells: Column, longs: int) -> Column:
    return F.getbit(F.get(cells, F.shiftright(v, 6).bitwiseAND(F.lit(longs - 1).cast("bigint")).cast("int")), v.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


def places_in(values: Column, cells: Column, longs: int) -> Column:
    """The place of each value that hits in the table, null for the others."""
    return F.transform(values, lambda v, i: F.when(in_table(v, cells, longs), i))


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """window (its words), size, and items, the sorted ids as strings, that have it."""
    rows = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(WINDOW))).select("item", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    rows = rows.select("item", "size", F.array_join(F.expr("slice(w, at, size)"), " ").alias("window")).where("item is not null")
    return rows.groupBy("window", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hashed(rows: DataFrame) -> DataFrame:
    """rows with w (words) and, besides, n and h (a hash for each word)."""
    return rows.withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def fingerprints(windows: DataFrame) -> DataFrame:
    """v and size for item windows: the fingerprint, of short windows the hash of all words."""
    rows = hashed(windows.select("size", F.split("window", " ").alias("w")))
    rows = rows.withColumn("g", gram_hashes(F.col("h"), F.col("n"), GRAM))
    whole = F.lit(None).cast("bigint")
    for size in range(1, WINDOW):
        whole = F.when(F.col("size") == size, F.xxhash64(*(F.get("h", F.lit(k)) for k in range(size)))).otherwise(whole)
    return rows.select("size", F.when(F.col("size") == WINDOW, F.array_min(F.filter("g", lambda x: x.isNotNull()))).otherwise(whole).alias("v")).distinct()


def windows_at(starts: Column, size: int) -> Column:
    """Of an array of starts (nulls left out) the windows there: start, size, words."""
    return F.transform(F.array_compact(starts), lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice("w", i + 1, F.lit(size)), " ").alias("window")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, text_hash, n_words, n_hit (words inside any occurrence of an item's window) and items (the sorted ids, as strings, of items with occurring windows).

    A null or empty text has no words; a document with a null id is like any other; neither a null item text nor an item with a null id matches anything. Repeated rows stay; other columns are dropped; without documents there are no rows, without items no hits.
    """
    windows = item_windows(items, item_key, item_text)
    known = windows.count()
    small = known <= TABLE_WINDOWS
    prints = fingerprints(windows)
    rows = hashed(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w")))
    rows = rows.withColumn("g", gram_hashes(F.col("h"), F.col("n"), GRAM)).withColumn("m", window_minima(F.col("g"), F.col("n")))
    by_size: dict[int, list[int]] = {}
    if small:
        for r in prints.collect():  # of the items, and no more than TABLE_WINDOWS
            by_size.setdefault(r["size"], []).append(r["v"])
    else:
        by_size = {r["size"]: [] for r in windows.select("size").distinct().collect()}  # ten at most
    for size, values in sorted(by_size.items()):
        found = F.col("m") if size == WINDOW else gram_hashes(F.col("h"), F.col("n"), size)
        if small:
            starts = places_in(found, *bit_table(values))
        else:
            starts = F.transform(found, lambda v, i: F.when(v.isNotNull(), i))
        rows = rows.withColumn(f"s{size}", starts)
    keys = ["key", "text_hash"]
    if small:
        keys.append("row")  # one pass numbers the rows, so repeated rows stay apart
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        arrays = [windows_at(F.col(f"s{size}"), size) for size in sorted(by_size)]
        nothing = F.array().cast("array<struct<start:int,size:int,window:string>>")
        rows = rows.select(*keys, "n", F.explode_outer(F.concat(nothing, *arrays)).alias("c")).select(*keys, "n", "c.start", "c.size", "c.window")
        joined = rows.join(F.broadcast(windows.select(F.col("window").alias("_w"), "items")), F.col("window") == F.col("_w"), "left")
        return summed(joined, keys).drop("row").withColumnRenamed("key", key)
    # too many items for a table: documents' fingerprints (one for each run of windows with the same) meet the items' by a shuffle, then windows of documents that have one
    prints = prints.withColumnRenamed("v", "_v").withColumnRenamed("size", "_s")
    flat = None
    for size in sorted(by_size):
        part = rows.select(*keys, F.explode(F.array_distinct(F.array_compact(F.col("m") if size == WINDOW else gram_hashes(F.col("h"), F.col("n"), size)))).alias("v"), F.lit(size).alias("size"))
        flat = part if flat is None else flat.unionByName(part)
    chosen = flat.join(prints, (F.col("v") == F.col("_v")) & (F.col("size") == F.col("_s")), "left_semi").select(*keys).distinct()
    chosen = chosen.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"))
    picked = rows.join(chosen, F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    arrays = [windows_at(F.col(f"s{size}"), size) for size in sorted(by_size)]
    found = picked.select(*keys, "n", F.explode(F.concat(*arrays)).alias("c")).select(*keys, "n", "c.start", "c.size", "c.window")
    joined = found.join(windows.select(F.col("window").alias("_w"), "items"), F.col("window") == F.col("_w"))
    rest = rows.select(*keys, "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("string").alias("_w"), F.lit(None).cast("array<string>").alias("items"))
    done = summed(joined.select(*rest.columns).unionByName(rest), keys)
    return done.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_copy", "copies").withColumnRenamed("key", key)


def summed(joined: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.col("items").isNotNull()
    grouped = joined.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count(F.when(F.col("start").isNull(), 1)).alias("copies"),
        F.collect_set(F.when(hit, F.struct("start", "size"))).alias("hits"),
        F.collect_set(F.when(hit, F.col("items"))).alias("sets"),
    )
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    extra = [] if "row" in keys else ["copies"]
    return grouped.select(*keys, *extra, F.col("n").cast("bigint").alias("n_words"), F.size(places).cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))

"""Near duplicates by BagMinHash.

A document is the multiset of its shingles of five words. Each shingle and dyadic range of weights has a Poisson process of its own, whose points carry a time, a place in
the signature and a weight; those with a weight up to the shingle's count are the document's, and a signature keeps the earliest point of each place. The chance that two
documents keep the same point is their weighted Jaccard similarity. A process ends as soon as its next point is later than all that the signature holds.

Signatures are cut into bands. Every distinct text is compared with the first of the buckets of equal bands that it shares most of. Then all texts of a bucket that may
reach the similarity and are still of different classes are compared inside the bucket's task, which holds their multisets and joins classes as it goes; it gives only the
links that joined two, so fewer than its texts, whatever the number of pairs. Links count only as multiset overlap confirms them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, map_rows, release, tables, text_of

SHINGLE, LEAST = 5, 0.8
#: Places of a signature, and rows of a band: a pair at similarity 0.8 shares none of 42 bands three times in a million.
PLACES, ROWS = 256, 6
BANDS = PLACES // ROWS
#: Nearly five standard deviations below 0.8: pairs whose signatures agree in fewer places are not compared. At 0.8 that are three in a million, as with the bands.
AGREE = 0.68
#: Ids that are broadcast at most, to read only their texts; more are joined by a shuffle.
FEW = 400_000
#: Texts that are compared with the same one in a task.
TOGETHER = 512
#: Texts of a bucket, and their shingles, that a block holds on average; larger buckets are cut into blocks.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
#: Of a byte: itself (A-Z in lower case) in a word, else a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
REMEMBERED = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def odd(times: int) -> np.uint64:
    return np.uint64(times * int(ODD) & (1 << 64) - 1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: dict[bytes, int], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's shingles, sorted, and how often each occurs. Fewer words than a shingle has are one shingle; without words there is none."""
    words = text.encode("utf-8", "surrogatepass").translate(BYTES).split()
    h = np.array([known[w] for w in words], np.uint64)
    size = min(size, len(h))
    if not size:
        return h, np.zeros(0, np.int64)
    s = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        s = mix(s * ODD + h[k : len(h) - size + 1 + k])
    return np.unique(mix(s), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """A row of times of the earliest points for each multiset; infinity for an empty one."""
    docs, seeds, lengths, starts, limits = [], [], [], [], []
    for d, (elements, counts) in enumerate(bags):
        level, low = 0, 0
        while len(elements):  # level 0 holds weight 1, level k the weights above 2^(k-1) up to 2^k
            length = max(1, low)
            docs.append(np.full(len(elements), d))
            seeds.append(mix(elements + odd(level)))
            lengths.append(np.full(len(elements), length, np.float64))
            starts.append(np.full(len(elements), low))
            limits.append(counts)
            level, low = level + 1, low + length
            keep = counts > low
            elements, counts = elements[keep], counts[keep]
    sig = np.full(len(bags) * places, np.inf)
    if not docs:
        return sig.reshape(len(bags), places)
    doc, seed, length, start, limit = (np.concatenate(x) for x in (docs, seeds, lengths, starts, limits))
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        r = mix(seed + odd(step))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        q = mix(r ^ ODD)
        place = (q & np.uint64(places - 1)).astype(np.int64)
        weight = start + 1 + np.floor((q >> np.uint64(32)).astype(np.float64) * 2.0**-32 * length)
        own = weight <= limit
        np.minimum.at(sig, doc[own] * places + place[own], time[own])
        left = time <= sig.reshape(-1, places).max(axis=1)[doc]
        doc, seed, length, start, limit, time = (x[left] for x in (doc, seed, length, start, limit, time))
    return sig.reshape(len(bags), places)


def bands_of(small: np.ndarray) -> np.ndarray:
    """A row of band hashes for each signature of 16 bits a place."""
    band = np.arange(BANDS, dtype=np.uint64)[None, :] * ODD
    for k in range(ROWS):
        band = mix(band + small[:, k : BANDS * ROWS : ROWS].astype(np.uint64) * odd(k + 1))
    return band.view(np.int64)


def digest_of(text: Column) -> Column:
    """What equal texts share: half of a SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def sketch(rows: DataFrame) -> DataFrame:
    """doc, digest, n (shingles), sig (16 bits a place) and bands of each row (doc, digest, text); the last two null without words."""
    kind = rows.schema["doc"].dataType.simpleString()

    def make():
        known = WordHashes()

        def work(b: dict[str, list]) -> dict[str, list]:
            bags = [shingles(t, known) for t in b["text"]]
            small = (mix(signatures(bags).view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
            bands = bands_of(small)
            full = [len(e) > 0 for e, _ in bags]
            return {
                "doc": b["doc"],
                "digest": b["digest"],
                "n": [int(c.sum()) for _, c in bags],
                "sig": [small[i].tobytes() if f else None for i, f in enumerate(full)],
                "bands": [bands[i].tolist() if f else None for i, f in enumerate(full)],
            }

        return work

    return map_rows(rows.select("doc", "digest", "text"), f"doc {kind}, digest binary, n bigint, sig binary, bands array<bigint>", make)


BAG = "bag binary, times binary"


def bags_of(rows: DataFrame, wanted: DataFrame, once: bool) -> DataFrame:
    """node, bag (the hashes of its shingles) and times (how often each occurs, null if once) of the wanted nodes (node, doc, digest); `once` if no row is repeated."""
    few = wanted.count() <= FEW
    ids = wanted.select("node", F.col("doc").alias("_doc"), F.col("digest").alias("_digest"))
    found = rows.join(F.broadcast(ids) if few else ids, rows["doc"].eqNullSafe(F.col("_doc")) & (rows["digest"] == F.col("_digest"))).select("node", "text")

    def make():
        known = WordHashes()

        def work(b: dict[str, list]) -> dict[str, list]:
            bags = [shingles(t, known) for t in b["text"]]
            return {"node": b["node"], "bag": [e.astype("<u8").tobytes() for e, _ in bags], "times": [None if c.max(initial=1) == 1 else c.astype("<u4").tobytes() for _, c in bags]}

        return work

    made = map_rows(found, f"node bigint, {BAG}", make)
    return made if once else made.dropDuplicates(["node"])


def unpacked(bag: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    elements = np.frombuffer(bag, "<u8")
    return elements, np.ones(len(elements), np.int64) if times is None else np.frombuffer(times, "<u4").astype(np.int64)


def likely(sig: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray | int, least: float = LEAST) -> np.ndarray:
    """Whether signatures agree in enough places, and numbers of shingles are near enough, for the similarity."""
    return ((sig == other).mean(axis=-1) >= AGREE) & (np.minimum(n, m) >= least * np.maximum(n, m))


def agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows (a, b) of pairs that may reach the similarity."""
    part = lambda x: sketches.select(F.col("node").alias(x), F.col("sig").alias(f"_s{x}"), F.col("n").alias(f"_n{x}"))
    both = pairs.join(part("a"), "a").join(part("b"), "b")

    def make():
        def work(x: dict[str, list]) -> dict[str, list]:
            left, right = (np.frombuffer(b"".join(x[c]), "<u2").reshape(-1, PLACES) for c in ("_sa", "_sb"))
            keep = np.flatnonzero(likely(left, np.array(x["_na"]), right, np.array(x["_nb"])))
            return {c: [x[c][i] for i in keep] for c in ("a", "b")}

        return work

    return map_rows(both.select("a", "b", "_sa", "_sb", "_na", "_nb"), "a bigint, b bigint", make, 4096)


def confirmed(pairs: DataFrame, bags: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows (a, b) of distinct pairs whose multisets overlap enough; each a has one b. Multisets of a go to where that of b is; a b with many partners goes to several tasks."""
    hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("fan")).where("fan > 1")
    hot = hot.withColumnRenamed("b", "_b")
    some = pairs.join(F.broadcast(hot) if hot.count() <= FEW else hot, F.col("b") == F.col("_b"), "left")
    part = F.pmod(F.xxhash64("a"), F.coalesce("fan", F.lit(1))).cast("int").alias("part")
    dealt = some.select(F.col("a").alias("node"), F.col("b").alias("with"), part, F.lit(1).alias("role"))
    hubs = dealt.select(F.col("with").alias("node"), "with", "part", F.lit(0).alias("role")).distinct()
    rows = dealt.unionByName(hubs).join(bags, "node")
    rows = rows.repartition("with", "part").sortWithinPartitions("with", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bag = None, None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for i, hub, role, e, times in zip(*(batch.column(c) for c in ("node", "with", "role", "bag", "times")), strict=True):
                i, hub, own = i.as_py(), hub.as_py(), unpacked(e.as_py(), times.as_py())
                if not role.as_py():
                    at, bag = hub, own
                elif at == hub and similarity(own, bag) >= least:
                    out["a"].append(i)
                    out["b"].append(hub)
            yield pa.RecordBatch.from_pydict(out, schema)
        release()

    return rows.select("node", "with", "role", "bag", "times").mapInArrow(run, "a bigint, b bigint")


def dealt(buckets: DataFrame, labels: DataFrame, inside: bool) -> DataFrame:
    """The rows (band, node, n) of buckets that still have several classes, dealt to tasks (band, o, q).

    inside: each row once, to its block q. Else, for buckets of several blocks: the texts outside the bucket's most frequent class are probes, which are cut into blocks o
    of their own; each block of probes meets each block of texts. With k texts and p probes that are about 2 k p / BLOCK rows, near 2 k as long as few texts are outside.
    """
    named = buckets.join(labels, "node")
    sizes = named.groupBy("band", "class").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    sizes = sizes.groupBy("band").agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.count("*").alias("classes"), F.max(F.struct("k", "m", "class")).alias("main")).where("classes > 1")
    blocks = lambda k, m: F.ceil(F.greatest(k / BLOCK, m / BLOCK_SHINGLES, F.lit(1))).cast("int")
    sizes = sizes.select("band", F.col("main.class").alias("main"), blocks(F.col("k"), F.col("m")).alias("blocks"), blocks(F.col("k") - F.col("main.k"), F.col("m") - F.col("main.m")).alias("probes"))
    rows = named.join(sizes if inside else sizes.where("blocks > 1"), "band")
    rows = rows.select("band", "node", "n", "class", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), (F.col("class") != F.col("main")).alias("outside"), "blocks", "probes")
    if inside:
        return rows.select("band", F.lit(0).alias("o"), F.col("block").alias("q"), "node", "n", "class", "block", "outside", F.lit(False).alias("probe"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = rows.select("band", upto("probes").alias("o"), F.col("block").alias("q"), "node", "n", "class", "block", "outside", F.lit(False).alias("probe"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("probes")).cast("int")
    probes = rows.where("outside").select("band", own.alias("o"), upto("blocks").alias("q"), "node", "n", "class", "block", "outside", F.lit(True).alias("probe"))
    return members.unionByName(probes)


class Group:
    """The texts that meet in a task, and which of them may be linked across classes: each pair in the first of the buckets that it shares, in one task."""

    def __init__(self, band: int, rows: list[tuple], inside: bool) -> None:
        self.node, self.n, self.cls, self.block, self.outside, self.probe = (np.array([r[i] for r in rows]) for i in range(6))
        self.sig = np.frombuffer(b"".join(r[6] for r in rows), "<u2").reshape(-1, PLACES)
        self.bags = [(r[7], r[8]) for r in rows] if len(rows[0]) > 7 else []
        self.band, self.inside = band, inside

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """A text, and those of other classes that may reach the similarity with it, the most alike first."""
        values, counts = np.unique(self.cls, return_counts=True)
        if len(values) == 1:
            return
        at = bands_of(self.sig[:1])[0].tolist().index(self.band)
        order = np.arange(len(self.node))
        first = self.cls != values[counts.argmax()] if self.inside else self.probe
        for i in np.flatnonzero(first):
            may = ~first | (order > i) if self.inside else ~self.probe & (self.block != self.block[i]) & (~self.outside | (self.node < self.node[i]))
            y = np.flatnonzero(may & (self.cls != self.cls[i]))
            y = y[np.minimum(self.n[i], self.n[y]) >= LEAST * np.maximum(self.n[i], self.n[y])]
            same = self.sig[i] == self.sig[y]
            agree = same.mean(axis=1)
            keep = (agree >= AGREE) & (same[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == at)
            y = y[keep][np.argsort(-agree[keep], kind="stable")]
            if len(y):
                yield i, y

    def flagged(self) -> list[int]:
        found: set[int] = set()
        for i, y in self.candidates():
            found.update([int(self.node[i]), *self.node[y].tolist()])
        return sorted(found)

    def links(self) -> list[tuple[int, int]]:
        """The links that join two classes: a forest, so fewer than texts."""
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = c = root.get(root[c], root[c])
            return c

        found = []
        for i, y in self.candidates():
            own = unpacked(*self.bags[i])
            for j in y.tolist():
                x, z = find(int(self.cls[i])), find(int(self.cls[j]))
                if x != z and similarity(own, unpacked(*self.bags[j])) >= LEAST:
                    root[max(x, z)] = min(x, z)
                    found.append((int(self.node[i]), int(self.node[j])))
        return found


def by_group(rows: DataFrame, columns: list[str], inside: bool, schema: str, work: Callable[[tuple, Group], list[tuple]]) -> DataFrame:
    """work's rows for each (band, o, q)."""
    rows = rows.select("band", "o", "q", *columns).repartition("band", "o", "q").sortWithinPartitions("band", "o", "q")
    arrow = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.int32()) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = work(at, Group(at[0], group, inside)) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

        at, group = None, []
        for batch in batches:
            for band, o, q, *row in zip(*(batch.column(c).to_pylist() for c in ("band", "o", "q", *columns)), strict=True):
                if (band, o, q) != at:
                    yield flush()
                    at, group = (band, o, q), []
                group.append(tuple(row))
        yield flush()
        group.clear()
        release()

    return rows.mapInArrow(run, schema)


def joining(buckets: DataFrame, sketches: DataFrame, labels: DataFrame, rows: DataFrame, bags: list[DataFrame], once: bool, inside: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Confirmed links (a, b) between classes, no more than texts in each bucket's tasks. Only texts that may have a link are read again; their multisets are added to bags."""
    columns = ["node", "n", "class", "block", "outside", "probe", "sig"]
    rest = dealt(buckets, labels, inside).join(sketches.select("node", "sig"), "node")
    flagged = keep(by_group(rest, columns, inside, "band bigint, o int, q int, node bigint", lambda at, group: [(*at, x) for x in group.flagged()]))
    wanted = flagged.select("node").distinct()
    for b in bags:
        wanted = wanted.join(b.select("node"), "node", "left_anti")
    wanted = keep(sketches.select("node", "doc", "digest").join(wanted, "node"))
    if not wanted.isEmpty():
        bags.append(keep(bags_of(rows, wanted, once)))
    every = bags[0]
    for b in bags[1:]:
        every = every.unionByName(b)
    met = rest.join(flagged, ["band", "o", "q", "node"]).join(every, "node")
    return by_group(met, [*columns, "bag", "times"], inside, "a bigint, b bigint", lambda at, group: group.links())


def components(labels: DataFrame, links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labels (node, class) after links (a, b) join classes: each class points to the least it is linked with, pointers are followed to their end, and again until no link is between classes."""
    one, two = labels.select(F.col("node").alias("a"), F.col("class").alias("x")), labels.select(F.col("node").alias("b"), F.col("class").alias("y"))
    edges = keep(links.join(one, "a").join(two, "b").where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while not edges.isEmpty():
        to = keep(edges.groupBy("x").agg(F.min("y").alias("y")))
        while True:  # followed pointers get shorter by half each time
            on = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
            new = keep(to.join(on, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")))
            to = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        ends = to.select(F.col("x").alias("class"), F.col("y").alias("end"))
        labels = keep(labels.join(ends, "class", "left").select("node", F.coalesce("end", "class").alias("class")))
        tx, ty = to.select("x", F.col("y").alias("_x")), to.select(F.col("x").alias("y"), F.col("y").alias("_y"))
        edges = edges.join(tx, "x", "left").join(ty, "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
        edges = keep(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    return labels


def grouped(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc, digest, class_id and kept (whether the row, or one like it, stands for its class) of each row."""
    rows = docs.select(docs[key].alias("doc"), text_of(text).alias("text")).withColumn("digest", digest_of(F.col("text")))
    with tables(docs.sparkSession) as keep:
        sketches = keep(sketch(rows))
        each = sketches.groupBy("digest", "doc").agg(F.count("*").alias("c"))
        texts = keep(each.groupBy("digest").agg(F.min("doc").alias("first"), F.sum("c").alias("copies"), F.max("c").alias("times")))
        total, once = max(1, sketches.count()), texts.where("times > 1").isEmpty()
        firsts = texts.select(F.col("digest").alias("_digest"), "first")
        distinct = sketches.where("bands is not null").join(firsts, (F.col("digest") == F.col("_digest")) & F.col("doc").eqNullSafe(F.col("first")), "left_semi")
        distinct = keep((distinct if once else distinct.dropDuplicates(["digest"])).withColumn("node", F.monotonically_increasing_id()))
        buckets = distinct.select("node", "n", F.explode("bands").alias("band"))
        heads = keep(buckets.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("k")).where("k > 1"))
        shared = keep(attach(buckets, heads, "band", "k", max(1, distinct.count() * BANDS), ["node"], BANDS * 1000).where("head is not null"))
        edges = shared.where("node <> head").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("bands"))
        nearest = edges.groupBy("a").agg(F.min_by("b", F.struct(-F.col("bands"), F.col("b"))).alias("b"))
        checked = keep(agreeing(nearest, distinct))
        wanted = keep(distinct.select("node", "doc", "digest").join(checked.select(F.col("a").alias("node")).union(checked.select("b")).distinct(), "node"))
        bags = [keep(bags_of(rows, wanted, once))]
        labels = distinct.select("node", F.col("node").alias("class"))
        labels = components(labels, keep(confirmed(checked, bags[0])), keep)
        for inside in (True, False):
            links = keep(joining(shared.select("band", "node", "n"), distinct, labels, rows, bags, once, inside, keep))
            labels = components(labels, links, keep)
        named = labels.join(distinct.select("node", "doc", "digest"), "node")
        of_class = named.groupBy("class").agg(F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "digest"))).alias("one"), F.min(F.struct("doc", "digest")).alias("other"), F.count("*").alias("k"))
        of_class = keep(of_class.select("class", "k", F.coalesce("one", "other").alias("stands")))
        named = attach(named, of_class, "class", "k", max(1, distinct.count()), ["node"]).select(F.col("digest").alias("_digest"), "stands")
        named = texts.join(named, F.col("digest") == F.col("_digest"), "left").select(F.hex("digest").alias("digest"), "copies", F.coalesce("stands.doc", "first").alias("class_id"), F.hex(F.coalesce("stands.digest", "digest")).alias("stands"))
        found = attach(sketches.select("doc", F.hex("digest").alias("digest")), keep(named), "digest", "copies", total, ["doc"])
        return cut(found.select("doc", F.unhex("digest").alias("digest"), "class_id", (F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("stands"))).alias("kept")))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and class_id of each row: the least id of all that it is linked with, directly or through others, by equal texts or a similarity of 0.8 or more.

    Texts without words, null ones among them (a null text is empty), are linked with equal texts only. Rows are told apart by id and text: those with one id and different
    texts are linked only as their texts are. A row with a null id is linked like any other; a class without any id has a null class_id. Ids are of any type that has an
    order. Repeated rows stay, other columns are dropped, an empty table gives an empty one.
    """
    return grouped(docs, text, key).select(F.col("doc").alias(key), "class_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all columns, that stand for their class: the one with the least id (of several texts with that id that with the least digest; a null id only if no other has one), of repeated rows one."""
    found = grouped(docs, text, key)
    gone = cut(found.where("not kept").select(F.col("doc").alias("__gone"), F.col("digest").alias("__gone_digest")).distinct())
    few = gone.count() <= FEW
    same = docs[key].eqNullSafe(F.col("__gone")) & (digest_of(text_of(text)) == F.col("__gone_digest"))
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = cut(found.where("kept").groupBy("doc", "digest").count().where("count > 1").select(F.col("doc").alias("__again"), F.col("digest").alias("__again_digest")))
    if again.isEmpty():
        return left
    left = left.withColumn("__digest", digest_of(text_of(text)))
    same = F.col(key).eqNullSafe(F.col("__again")) & (F.col("__digest") == F.col("__again_digest"))
    several = left.join(again, same, "left_semi").dropDuplicates([key, "__digest"])
    return left.join(again, same, "left_anti").unionByName(several).drop("__digest")

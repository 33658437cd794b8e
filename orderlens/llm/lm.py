"""Language-model scoring with a log-bilinear model learned by noise-contrastive estimation.

The model knows the corpus's most frequent words, as many as occur OFTEN or more, up to `words`. A context of WIDTH tokens is mapped to a vector, the sum of each token's
own vector through its place's matrix. Known words are dealt to classes of MEMBERS by frequency, all other words to OTHERS classes by their last bytes. The product of the
context's vector with each class's, normalised over all classes, gives the class; the product with each member's own vector, normalised over the class, gives the word. A
word that is not known has instead its smoothed share of its class, from counts over the whole corpus. As context, words that are not known have vectors by their first
bytes.

Each task learns from all positions of its training texts, each once, in random order (again only if they are too few; a `stride` other than 1 asks for fewer); class noise is
shared by a step's examples, word noise, drawn inside the class, by at most SHARED of them. Learned vectors are averaged over tasks, each weighing as often as it was learned, in blocks of ids; only the average comes
to the driver. Counts of words are gathered from all training texts. The HEAD most frequent words are known to every worker with their counts; the others meet theirs by a
shuffle, so no frequent word's rows meet in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import cut, fold, release, slices, tables, text_of

#: Words whose counts every worker knows, of at most LONGEST bytes each, so that they are bounded in bytes too.
HEAD, LONGEST = 262_144, 64
#: Words that the model knows at most, how often they occur at least, members of a class.
WORDS, OFTEN, MEMBERS = 65_536, 4, 256
#: Classes of all other words, and vectors of them as context.
OTHERS, FRONTS = 64, 4_096
#: Tokens of context, length of a vector, noise of a step (classes, shared) and of an example (words).
WIDTH, VECTOR, CLASS_NOISE, WORD_NOISE = 4, 16, 32, 6
#: Examples of a step, at least and at most, and those of a class that share their noise words; positions of a task for each example (all are examples); steps of a task at
#: least; positions that a task gathers before it learns from them.
EXAMPLES, MOST_EXAMPLES, SHARED, STRIDE, LEAST_STEPS, GATHERED = 256, 4096, 16, 1, 1000, 4_000_000
#: The rate at which a task begins to learn.
RATE = 0.12
#: Rows of an id that are summed one by one with those of all other ids.
FEW = 4
#: Contexts of a product when scoring.
CONTEXTS = 256
#: Texts that are split at once, at most, and their bytes, but for single texts that have more.
ROWS, SLICE = 1024, 1 << 22
#: Ids in a block of vectors on their way to the average.
BLOCK = 4_096
#: The end of a text in the table of counts; no word is empty.
END_WORD = b""


def tokens(text: str) -> list[bytes]:
    """The words of a text: A-Z in lower case, between spaces and the controls from tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts, each text's as tokens() gives them and then an end, and where each text begins; by Arrow, in less time."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    ended = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(texts, "", " "))  # behind the last space is the empty word
    lists = pc.ascii_split_whitespace(ended)
    return lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()[:-1].astype(np.int64)


def words_counted(texts: DataFrame, held: int = 300_000) -> DataFrame:
    """word (binary) and c, how often each token is there over all rows of texts (text). Tasks count what they read, with at most `held` words and those of a slice at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        seen: dict[bytes, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = list(seen.keys()), list(seen.values())
            for i in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.binary()), pa.array(counts[i : i + 20_000], pa.int64())], schema=schema)

        for batch in batches:
            for part in slices(batch, ROWS, SLICE):
                coded = split(part.column(0))[0].dictionary_encode()
                for w, c in zip(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(coded.indices.to_numpy()).tolist(), strict=True):
                    seen[w] = seen.get(w, 0) + c
                if len(seen) > held:
                    yield from out()
                    seen.clear()
        yield from out()
        seen.clear()
        release()

    return texts.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def other_class(word: bytes) -> int:
    """The class, of OTHERS, of a word that the model does not know."""
    return zlib.crc32(word[-3:]) % OTHERS


class Lookup:
    """What learning and scoring need of the counts. The number of a word with a known count is its place among them; of any other word their number, plus its class and front."""

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int, other_n: dict[int, int], other_v: dict[int, int], known: int = WORDS) -> None:
        self.n, self.v, self.words = n, v, words
        c = np.array(counts, np.float64)
        self.known = k = min(known, int((c >= OFTEN).sum()))  # words come by falling count
        self.classes = -(-k // MEMBERS)
        for w, x in zip(words[:k], counts[:k], strict=True):  # what is known has left its other class
            if w != END_WORD:
                other_n[other_class(w)] = other_n.get(other_class(w), 0) - x
                other_v[other_class(w)] = other_v.get(other_class(w), 0) - 1
        mass = np.array([other_n.get(i, 0) + 0.5 * (other_v.get(i, 0) + 1) for i in range(OTHERS)])
        self.other_base = np.log10(mass)
        rest = [other_class(w) if w != END_WORD else 0 for w in words[k:]]
        self.rest_class = np.array(rest, np.int32) + self.classes
        self.rest_within = np.log10(c[k:] + 0.5) - self.other_base[rest] if rest else np.zeros(0)
        self.rest_front = np.array([zlib.crc32(w[:3]) % FRONTS for w in words[k:]], np.int32) + k
        self.base_of = math.log10(n + 0.5 * (v + 1))
        self.base = np.log10(c + 0.5) - self.base_of
        #: Chance of each class, and of each known word in its own.
        smooth = c[:k] + 0.5
        total = np.add.reduceat(smooth, np.arange(0, k, MEMBERS)) if k else np.zeros(0)
        self.class_share = np.concatenate([total, mass]) / (total.sum() + mass.sum())
        self.word_share = smooth / np.repeat(total, MEMBERS)[:k] if k else smooth

    def numbers(self, tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """The numbers of tokens, and those of them that have no known count; words are self.words in Arrow."""
        at = pc.index_in(tokens, value_set=words)
        far = tokens.filter(at.is_null()).to_numpy(zero_copy_only=False).tolist()
        out = at.fill_null(-1).to_numpy().copy()
        out[out < 0] = [len(self.words) + other_class(w) * FRONTS + zlib.crc32(w[:3]) % FRONTS for w in far]
        return out, far

    def split(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of numbers the class, and the id as context."""
        k, h = self.known, len(self.words)
        far = number - h
        cls = np.where(number < k, number // MEMBERS, self.classes + np.maximum(far, 0) // FRONTS)
        ctx = np.where(number < k, number, k + np.maximum(far, 0) % FRONTS)
        rest = np.flatnonzero((number >= k) & (number < h))
        cls[rest], ctx[rest] = self.rest_class[number[rest] - k], self.rest_front[number[rest] - k]
        return cls, ctx

    @property
    def begin(self) -> int:
        """The context's id before a text; ids go up to it."""
        return self.known + FRONTS

    def padded(self, ctx: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context ids of texts, one after the other, with WIDTH times begin before each, and where each position has gone."""
        where = np.repeat(np.arange(1, len(starts) + 1, dtype=np.int32) * WIDTH, np.diff(np.append(starts, len(ctx))))
        where += np.arange(len(ctx), dtype=np.int32)
        ids = np.full(len(ctx) + WIDTH * len(starts), self.begin, np.int32)
        ids[where] = ctx
        return ids, where


def lookup(counts: DataFrame, known: int = WORDS) -> Lookup:
    """From the table of counts; of single words only the HEAD most frequent come here."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(OTHERS, np.int64), np.zeros(OTHERS, np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w != END_WORD:
                    k = other_class(w)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_pydict({"k": list(range(OTHERS)), "n": n.tolist(), "v": v.tolist()}, pa.schema([("k", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))

    by_class = counts.select("word", "c").mapInArrow(run, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    return Lookup(top.column("word").to_pylist(), top.column("c").to_pylist(), total.n, total.v, {r.k: r.n for r in by_class}, {r.k: r.v for r in by_class}, known)


def fresh(at: Lookup, seed: int = 1) -> dict[str, np.ndarray]:
    """The model before learning: the shares of classes and words, whatever the context. All tasks begin with the same."""
    rng = np.random.default_rng(seed)
    d, classes = VECTOR, at.classes + OTHERS
    return {
        "context": rng.normal(0, 0.3, (at.begin + 1, d)).astype(np.float32),
        "place": np.stack([np.eye(d, dtype=np.float32) * x for x in (0.6, 0.4, 0.3, 0.3, 0.2)[:WIDTH]]),
        "class": np.zeros((classes, d + 1), np.float32) + np.append(np.zeros(d), 1).astype(np.float32) * np.log(at.class_share)[:, None].astype(np.float32),
        "word": np.concatenate([np.zeros((at.known, d)), np.log(at.word_share)[:, None]], axis=1).astype(np.float32),
    }


def spread(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the rows of each id, and the ids, those with most rows first. A row at a time is added for all ids at once; what the few ids with more than FEW rows have
    beyond is summed by segments, which cost a call for each id and column."""
    order = np.sort(ids.astype(np.int64) << 32 | np.arange(len(ids)))  # faster than argsort
    ids, order = order >> 32, order & 0xFFFFFFFF
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    length = np.diff(np.append(starts, len(ids)))
    by = np.argsort(np.maximum(-length, -FEW - 1).astype(np.int8), kind="stable")
    starts, length = starts.take(by), length.take(by)
    sums = rows.take(order.take(starts), axis=0)
    have = len(starts) - np.cumsum(np.bincount(np.minimum(length, FEW + 1), minlength=FEW + 2))  # how many ids have more than 0, 1, ... rows
    for r in range(1, FEW):
        sums[: have[r]] += rows.take(order.take(starts[: have[r]] + r), axis=0)
    if many := have[FEW]:
        more = length[:many] - FEW
        first = np.cumsum(more) - more
        rest = np.arange(int(more.sum())) + np.repeat(starts[:many] + FEW - first, more)
        sums[:many] += np.add.reduceat(rows.take(order.take(rest), axis=0), first, axis=0)
    return ids.take(starts), sums


def sigma(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(z)), in z's place."""
    np.exp(np.minimum(z, np.float32(30), out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def less(vectors: np.ndarray, log: np.ndarray) -> np.ndarray:
    """What gives log less the product of the vectors, whose last is for the bias."""
    out = -vectors
    out[..., -1] += log
    return out


class Learner:
    """Noise-contrastive estimation by steps with Adagrad, on the vectors that a step meets."""

    def __init__(self, at: Lookup, seed: int = 1) -> None:
        self.at, self.p = at, fresh(at, seed)
        self.squares = {n: np.full(len(x), 1e-2, np.float32) for n, x in self.p.items() if n != "place"} | {"place": np.full(self.p["place"].shape, 1e-2, np.float32)}
        self.met = {n: np.zeros(len(x), np.float32) for n, x in self.p.items() if n != "place"}
        self.steps, self.rng = 0, np.random.default_rng(seed + 1)
        self.class_ends, self.class_log = np.cumsum(at.class_share), np.log(CLASS_NOISE * at.class_share).astype(np.float32)
        self.word_ends = np.cumsum(at.word_share)
        self.word_log = np.log(WORD_NOISE * at.word_share).astype(np.float32)

    def move(self, name: str, ids: np.ndarray, grads: np.ndarray, rate: float) -> None:
        ids, grads = spread(ids, grads)
        squares = self.squares[name].take(ids) + np.einsum("ij,ij->i", grads, grads) / np.float32(grads.shape[1])
        self.squares[name][ids] = squares
        grads *= (np.float32(rate) / np.sqrt(squares))[:, None]
        self.p[name][ids] = np.subtract(self.p[name].take(ids, axis=0), grads, out=grads)
        self.met[name][ids] += 1

    def step(self, context: np.ndarray, cls: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One step on examples: context (a row of ids for each), class, and word (-1 if it is not known)."""
        p, at, rng = self.p, self.at, self.rng
        order = np.argsort(cls.astype(np.int16), kind="stable")  # by class, known words before all others
        context, cls, word = context.take(order, axis=0).reshape(-1), cls.take(order), word.take(order)
        first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        places = p["place"].reshape(WIDTH * VECTOR, VECTOR)
        own = p["context"].take(context, axis=0).reshape(len(cls), WIDTH * VECTOR)
        q = np.ones((len(cls), VECTOR + 1), np.float32)  # the last is for the bias
        np.matmul(own, places, out=q[:, :-1])
        false = np.minimum(np.searchsorted(self.class_ends, rng.random(CLASS_NOISE) * self.class_ends[-1], "right"), len(self.class_ends) - 1)
        c, f = p["class"].take(cls, axis=0), p["class"].take(false, axis=0)
        g1 = (sigma(self.class_log.take(cls) - np.einsum("ij,ij->i", q, c)) - 1)[:, None]
        g0 = sigma(q @ less(f, self.class_log.take(false)).T)
        gq = g1 * c + g0 @ f
        class_grads = np.concatenate([np.add.reduceat(g1 * q, first), g0.T @ q])
        m = int(np.searchsorted(cls, at.classes))
        if m:
            w, v, k = word[:m], q[:m], cls[:m]
            place = np.arange(m) - np.repeat(first, np.diff(np.append(first, len(cls))))[:m]
            starts = np.flatnonzero(place % SHARED == 0)
            slot = np.repeat(np.arange(len(starts)) * SHARED, np.diff(np.append(starts, m))) + place % SHARED
            low, high = k[starts] * MEMBERS, np.minimum(k[starts] * MEMBERS + MEMBERS, at.known)
            from_, to = np.where(low > 0, self.word_ends[np.maximum(low - 1, 0)], 0.0), self.word_ends[high - 1]
            noise = np.searchsorted(self.word_ends, from_[:, None] + rng.random((len(starts), WORD_NOISE)) * (to - from_)[:, None], "right")
            noise = np.clip(noise, low[:, None], high[:, None] - 1)
            t, n = p["word"].take(w, axis=0), p["word"].take(noise, axis=0)
            slots = np.zeros((len(starts), SHARED, VECTOR + 1), np.float32)  # those who share their noise, with empty places
            slots.reshape(-1, VECTOR + 1)[slot] = v
            h1 = (sigma(self.word_log.take(w) - np.einsum("ij,ij->i", v, t)) - 1)[:, None]
            h0 = sigma(slots @ less(n, self.word_log.take(noise)).transpose(0, 2, 1))
            gq[:m] += h1 * t + (h0 @ n).reshape(-1, VECTOR + 1).take(slot, axis=0)
            false_grads = h0.transpose(0, 2, 1) @ slots  # empty places are zero
            self.move("word", np.concatenate([w, noise.reshape(-1)]), np.concatenate([h1 * v, false_grads.reshape(-1, VECTOR + 1)]), rate)
        self.move("class", np.concatenate([cls[first], false]), class_grads, rate)
        gq = np.ascontiguousarray(gq[:, :-1])
        back = (gq @ places.T).reshape(-1, VECTOR)
        grad = (own.T @ gq).reshape(p["place"].shape)
        self.move("context", context, back, rate)
        self.squares["place"] += grad * grad
        p["place"] -= rate * 0.2 * grad / np.sqrt(self.squares["place"])
        self.steps += 1

    def learn(self, numbers: np.ndarray, starts: np.ndarray, stride: int, least: int) -> None:
        """Steps on all positions (with a stride, on one in so many) of texts, one after the other in numbers, each of which begins at one of starts. Positions come in random
        order, each once before any comes again; they come again only if there are too few for `least` steps."""
        at, n = self.at, len(numbers)
        cls, ctx = at.split(numbers)
        cls = cls.astype(np.int32)
        word = np.where(numbers < at.known, numbers, -1).astype(np.int32)
        ids, where = at.padded(ctx, starts)
        size = min(MOST_EXAMPLES, max(EXAMPLES, n // (stride * max(least, 1))))
        steps = max(least, -(-n // (size * stride)))
        order, back = self.rng.permutation(np.arange(n, dtype=np.int32)), np.arange(1, WIDTH + 1)
        del ctx
        for s in range(steps):
            i = order.take(np.arange(s * size, (s + 1) * size), mode="wrap")
            self.step(ids.take(where.take(i)[:, None] - back), cls.take(i), word.take(i), RATE * (1 - 0.8 * s / steps))

    def parts(self) -> Iterator[tuple[str, int, bytes, bytes, bytes]]:
        """What was learned, in blocks: name, block, ids, weights, rows."""
        if self.steps:
            yield "place", 0, np.zeros(1, "<i4").tobytes(), np.full(1, self.steps, "<f4").tobytes(), self.p["place"].astype("<f2").tobytes()
        for name, met in self.met.items():
            ids = np.flatnonzero(met)
            for block in np.unique(ids // BLOCK):
                some = ids[ids // BLOCK == block]
                yield name, int(block), some.astype("<i4").tobytes(), met[some].astype("<f4").tobytes(), self.p[name][some].astype("<f2").tobytes()


PART = "name string, block int, ids binary, weights binary, rows binary"
PART_SCHEMA = pa.schema([("name", pa.string()), ("block", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("rows", pa.binary())])


def learn(texts: DataFrame, shared, stride: int = STRIDE, least: int = LEAST_STEPS) -> dict[str, np.ndarray]:
    """The model, learned in all tasks from their texts and averaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        words, learner, held, size = pa.array(at.words, pa.binary()), Learner(at), [], 0

        def take() -> None:
            numbers = np.concatenate([n for n, _ in held])
            starts, done = [], 0
            for n, s in held:
                starts.append(s + done)
                done += len(n)
            held.clear()
            pa.default_memory_pool().release_unused()
            learner.learn(numbers, np.concatenate(starts), stride, max(0, least - learner.steps))

        for batch in batches:
            for part in slices(batch, ROWS, SLICE):
                found, starts = split(part.column(0))
                held.append((at.numbers(found, words)[0], starts))
                size += len(held[-1][0])
                if size >= GATHERED:
                    take()
                    size = 0
        if size:
            take()
        for name, block, *rest in learner.parts():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, block, *rest), PART_SCHEMA, strict=True)], schema=PART_SCHEMA)
        del words, learner, held
        release()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids, weights = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["weights"], "<f4").astype(np.float64)
                rows = np.frombuffer(r["rows"], "<f2").reshape(len(ids), -1).astype(np.float64)
                total, weight = sums.setdefault((r["name"], r["block"]), [np.zeros((BLOCK, rows.shape[1])), np.zeros(BLOCK)])
                total[ids % BLOCK] += weights[:, None] * rows
                weight[ids % BLOCK] += weights
        for (name, block), (total, weight) in sums.items():
            some = np.flatnonzero(weight)
            out = ((some + block * BLOCK).astype("<i4").tobytes(), weight[some].astype("<f4").tobytes(), (total[some] / weight[some, None]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, block, *out), PART_SCHEMA, strict=True)], schema=PART_SCHEMA)

    model = fresh(shared.value)
    learned = texts.select("text").mapInArrow(run, PART).repartition("name", "block").mapInArrow(average, PART)
    for r in learned.toArrow().to_pylist():
        ids = np.frombuffer(r["ids"], "<i4")
        rows = np.frombuffer(r["rows"], "<f4").reshape(len(ids), -1)
        if r["name"] == "place":
            model["place"] = rows.reshape(model["place"].shape).copy()
        else:
            model[r["name"]][ids] = rows
    return model


class Scorer:
    """log10 of the chance of each token, normalised over all classes and over the members of its class, by products of many contexts with many vectors."""

    def __init__(self, at: Lookup, model: dict[str, np.ndarray]) -> None:
        self.at = at
        self.places = [model["context"] @ m for m in model["place"]]
        longest = lambda v: float(np.sqrt((v * v).sum(axis=1)).max(initial=0))
        most = sum(longest(v) for v in self.places) * max(longest(model["class"][:, :-1]), longest(model["word"][:, :-1]))
        #: Whether no logit can be so large, or all so small, that exponentials in float32 go wrong.
        self.safe = most + max(float(np.abs(model[n][:, -1]).max(initial=0)) for n in ("class", "word")) < 75
        #: From here on logs are those to base 2, whose powers numpy has at hand. Vectors as columns, their biases, and these as factors.
        self.places = [v * np.float32(1 / math.log(2)) for v in self.places]
        side = lambda v: (np.ascontiguousarray(v[:, :-1].T), v[:, -1] / np.float32(math.log(2)), np.exp(v[:, -1]))
        self.classes = side(model["class"])
        self.members = [side(model["word"][k * MEMBERS : (k + 1) * MEMBERS]) for k in range(at.classes)]

    def log10(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = self.at
        cls, ctx = at.split(numbers)
        out = np.zeros(len(numbers))
        rest = np.flatnonzero((numbers >= at.known) & (numbers < len(at.words)))
        out[rest] = at.rest_within[numbers[rest] - at.known] * math.log2(10)
        ids, where = at.padded(ctx, starts)
        q = self.places[0].take(ids.take(where - 1), axis=0)
        for j, vectors in enumerate(self.places[1:], 2):
            q += vectors.take(ids.take(where - j), axis=0)
        out += self.chosen(q, self.classes, cls)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # by radix
        order = order[: np.searchsorted(cls[order], at.classes)]
        order = order[numbers[order] < at.known]
        edges = np.searchsorted(cls[order], np.arange(at.classes + 1))
        q, member = q.take(order, axis=0), numbers[order] % MEMBERS
        logs = np.zeros(len(order))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[k], edges[k + 1]
            logs[lo:hi] = self.chosen(q[lo:hi], self.members[k], member[lo:hi])
        out[order] += logs
        return out / math.log2(10)

    def chosen(self, q: np.ndarray, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], chosen: np.ndarray) -> np.ndarray:
        """For each row of q the log2 of the chance of the chosen of the vectors, a few hundred rows at a time."""
        columns, bias, factors = vectors
        own, total = np.empty(len(q), np.float32), np.empty(len(q), np.float32)
        for lo in range(0, len(q), CONTEXTS):
            z = q[lo : lo + CONTEXTS] @ columns
            own[lo : lo + CONTEXTS] = z[np.arange(len(z)), chosen[lo : lo + CONTEXTS]]
            if self.safe:
                np.matmul(np.exp2(z, out=z), factors, out=total[lo : lo + CONTEXTS])
            else:
                z += bias
                top = z.max(axis=1)
                own[lo : lo + CONTEXTS] -= top
                z -= top[:, None]
                total[lo : lo + CONTEXTS] = np.exp2(z, out=z).sum(axis=1)
        return own.astype(np.float64) + bias.take(chosen) - np.log2(total)


PARTS = "word binary, class int, n_tokens bigint, n_known bigint, base double, score double"


def scored(docs: DataFrame, shared, model) -> DataFrame:
    """For each row (row, id, text) what words with known counts give, and all contexts, under a word that no count has; and each occurrence of another word, under the word."""

    names = f"row bigint, id {docs.schema['id'].dataType.simpleString()}, {PARTS}"
    schema = to_arrow_schema(_parse_datatype_string(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        words, scorer = pa.array(at.words, pa.binary()), Scorer(at, model.value)
        known, base = len(at.words), at.base
        for batch in batches:
            for b in slices(batch, ROWS, SLICE):
                row, ids = b.column("row").to_numpy(), b.column("id")
                found, starts = split(b.column("text"))
                numbers, others = at.numbers(found, words)
                logs = np.zeros(len(numbers))
                ends = np.append(starts, len(numbers))
                first = 0
                while first < len(starts):  # so many texts at a time that the products stay in bounded memory
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] + 200_000, "right")) - 1)
                    logs[ends[first] : ends[last]] = scorer.log10(numbers[ends[first] : ends[last]], starts[first:last] - ends[first])
                    first = last
                near = numbers < known
                of_base = np.where(near, base[np.minimum(numbers, known - 1)] if known else 0.0, 0.0)
                far = np.flatnonzero(~near)
                doc = np.searchsorted(starts, far, "right") - 1
                none = np.zeros(len(far))
                classes = pa.concat_arrays([pa.nulls(len(row), pa.int32()), pa.array(((numbers[far] - known) // FRONTS).astype(np.int32))])
                columns = [
                    np.concatenate([row, row[doc]]), pa.concat_arrays([ids, ids.take(pa.array(doc))]), [b" %d" % r for r in row.tolist()] + others, classes,
                    np.concatenate([np.diff(ends), np.ones(len(far), np.int64)]), np.concatenate([np.add.reduceat(near.astype(np.int64), starts), none.astype(np.int64)]),
                    np.concatenate([np.add.reduceat(of_base, starts), none]), np.concatenate([np.add.reduceat(logs, starts), none]),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        del words, scorer
        release()

    return docs.select("row", "id", "text").mapInArrow(run, names)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", out: int = 1, words: int = WORDS, stride: int = STRIDE, least: int = LEAST_STEPS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text, learned from rows whose fold is not `out`.

    A text's tokens are its words and an end, so that an empty or null text has one. Ids are of any type; a null id has the fold of the empty text. Repeated rows stay and
    count as often in training, other columns are dropped; an empty table gives an empty one; without training rows all classes are equally likely.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    given = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    with tables(spark) as keep:
        learned = given.where(fold("id") != out)
        counts = keep(words_counted(learned))
        at = lookup(counts, words)
        shared = context.broadcast(at)
        model = context.broadcast(learn(learned, shared, stride, least))
        parts = scored(given.withColumn("row", F.monotonically_increasing_id()), shared, model)
        rare = counts.select(F.col("word").alias("_w"), "c")
        met = parts.join(rare, F.col("word") == F.col("_w"), "left")
        other = F.col("class").isNotNull()
        log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
        class_base = F.get(F.array(*(F.lit(float(x)) for x in at.other_base)), F.col("class"))
        done = met.select(
            "row", "id", F.when(~other, F.col("n_tokens")).alias("n_tokens"),
            F.when(~other, F.col("n_known")).when(F.col("c").isNotNull(), F.col("n_tokens")).otherwise(0).alias("n_known"),
            F.when(other, F.col("n_tokens") * (log_c - at.base_of)).otherwise(F.col("base")).alias("base"),
            F.when(other, F.col("n_tokens") * (log_c - class_base)).otherwise(F.col("score")).alias("score"),
        ).groupBy("row", "id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        return cut(done.select(F.col("id").alias(key), (fold("id") == out).alias("held_out"), "n_tokens", "n_known", F.lit(at.n).cast("bigint").alias("train_tokens"), "base_score", "score"))

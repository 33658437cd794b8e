"""Toxicity by multiple-instance learning.

A document's label says that some sentence of it is toxic, not which. A sentence's score is a logistic model of its words, a document's the noisy-or of its sentences'
scores; the loss is on the documents' labels, and its gradient finds the sentences. Scores of sentences then locate what is offending.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, map_rows, text_of

#: The most labelled documents that the model learns from, of each label: those with the least hash of their id.
SAMPLE = {1: 2_000, 0: 5_000}
#: Features known to the model: those in one of SHARE toxic samples or more (LEAST[0] to LEAST[1] samples, with the number of labels) whose likelihood ratio between the labels
#: is that of CERTAIN standard errors or more above 0, at most KNOWN.
LEAST, SHARE, CERTAIN, KNOWN = (3, 8), 40, 3.8, 20_000
#: Bytes of text that the sample has at most; it ends before the document that would exceed it.
SAMPLE_BYTES = 64_000_000
#: The share of toxic labels that nothing in the text explains. While learning, it joins the noisy-or, so that such documents do not raise every sentence's score.
LEAK = 0.05
#: Of a byte: itself (A-Z in lower case) in a word, a line's end where a sentence ends, else a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 10 if c in b".!?\n" else 32 for c in range(256))
SENTENCE = re.compile(r"[^.!?\n]+")
#: Bytes in a part of a word, and distinct words whose weight a worker remembers.
PARTS, REMEMBERED = (4, 5, 6), 100_000
SPANS = "array<struct<start:int,end:int,score:double>>"


def sentences(text: str) -> list[list[bytes]]:
    """The words of each sentence, one for each match of SENTENCE."""
    return [s.split() for s in text.encode("utf-8", "surrogatepass").translate(BYTES).split(b"\n") if s]


def features(word: bytes) -> set[bytes]:
    """The word between marks, and its parts."""
    marked = b"<" + word[:64] + b">"
    return {marked} | {marked[i : i + n] for n in PARTS for i in range(len(marked) - n + 1)}


class Weights(dict):
    """The weight of each word, from those of its features, as it is first asked for."""

    def __init__(self, of_features: dict[bytes, float]) -> None:
        super().__init__()
        self.of_features = of_features
        #: The first bytes of all features; few words have any, so the others cost a few slices.
        self.first = {f[: PARTS[0]] for f in of_features}

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        marked, first, n = b"<" + word[:64] + b">", self.first, PARTS[0]
        if not any(marked[i : i + n] in first for i in range(max(1, len(marked) - n + 1))):
            if len(word) <= 64:
                self[word] = 0.0
            return 0.0
        found = self[word] = sum(self.of_features.get(f, 0.0) for f in sorted(features(word) & self.of_features.keys()))
        return found


class Model:
    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words = Weights(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence_scores(self, text: str) -> list[float]:
        words, bias = self.words, self.bias
        return [sum([words[w] for w in set(s)]) + bias for s in sentences(text)]

    def score(self, text: str, at: float = 0.5) -> tuple[float, list[dict]]:
        """The text's score, and the sentences (code points) that score `at` or more. No sentence, no toxicity: 0."""
        logits = self.sentence_scores(text)
        none = -sum(z if z > 30 else math.log1p(math.exp(z)) for z in logits)
        least = math.log(at / (1 - at))
        found = []
        if any(z >= least for z in logits):
            spans = SENTENCE.finditer(text)
            found = [{"start": m.start(), "end": m.end(), "score": 1 / (1 + math.exp(-min(z, 700)))} for m, z in zip(spans, logits, strict=True) if z >= least]
        return -math.expm1(none), found


def deviance(a: float, n1: float, c: float, n0: float) -> float:
    """The signed root of the likelihood ratio that a feature, in a of n1 and c of n0 documents, is as frequent in both: about standard errors, also where c is 0."""
    each = lambda x, n, p: (x * math.log(x / (n * p)) if x else 0.0) + ((n - x) * math.log((n - x) / (n * (1 - p))) if x < n else 0.0)
    p = (a + c) / (n1 + n0)
    return 0.0 if p == 1 else math.copysign(math.sqrt(max(0.0, 2 * (each(a, n1, p) + each(c, n0, p)))), a / n1 - c / n0)


def fit(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Full-batch Adam on the mean log-loss of noisy-or, both labels weighing the same; features' weights decay, the bias does not."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():  # one label only, or none: nothing to tell apart
        return Model({}, -12.0 if not len(y) or y.max() == 0 else 12.0)
    n1, n0 = y.sum(), len(y) - y.sum()

    def of(text: str) -> set[bytes]:
        return set().union(*(features(w) for w in {w for s in sentences(text) for w in s}))

    seen = Counter(f for t, k in zip(texts, labels, strict=True) if k for f in of(t))
    seen = {f: n for f, n in seen.items() if n >= max(LEAST[0], min(LEAST[1], n1 / SHARE))}
    clean = Counter(f for t, k in zip(texts, labels, strict=True) if not k for f in of(t) & seen.keys())
    telling = {f: deviance(seen[f], n1, clean[f], n0) for f in seen}
    words = sorted((f for f, z in telling.items() if z >= CERTAIN), key=lambda f: (-telling[f], f))[:KNOWN]
    if not words:  # nothing tells the labels apart, so the more frequent one is all there is to say
        return Model({}, -12.0)
    index = {f: i for i, f in enumerate(words)}
    feature, of_sentence, of_doc = [], [], []
    for d, text in enumerate(texts):
        for s in sentences(text):
            known = [index[f] for w in set(s) for f in sorted(features(w) & index.keys())]
            feature += known
            of_sentence += [len(of_doc)] * len(known)
            of_doc.append(d)
    feature, of_sentence, of_doc = (np.array(x, np.int64) for x in (feature, of_sentence, of_doc))
    each = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(words)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(of_sentence, w[feature], len(of_doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.bincount(of_doc, np.logaddexp(0, z), len(y))  # minus the log of the chance that no sentence is toxic
        share = np.where(y == 1, -(1 - LEAK) * np.exp(-none) / (LEAK - (1 - LEAK) * np.expm1(-none)), 1.0) * each
        g = share[of_doc] * p
        gw = np.bincount(feature, g[of_sentence], len(words)) + decay * w / len(words)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        step = rate if t < rounds * 2 // 3 else rate / 4
        w -= step * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= step * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model({x: float(k) for x, k in zip(words, w, strict=True) if abs(k) > 1e-3}, float(b))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: dict[int, int] | None = None, most: int = SAMPLE_BYTES) -> Model:
    """Learns from a bounded sample of labelled documents whose fold is not 0: `sample` of each label at most, and `most` bytes of text, by the hash of their id.

    Of several labels for an id the largest counts, of several texts the least; null labels and ids teach nothing.
    """
    sample = sample or SAMPLE
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 0)).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    here = docs.select(F.col(key).alias("_id")).distinct()
    known = known.join(here, "_id", "left_semi")
    known = known.withColumn("_hash", F.xxhash64("_id"))
    parts = [known.where(F.col("_label") == k).orderBy("_hash", "_id").limit(n) for k, n in sorted(sample.items())]
    chosen = cut(parts[0].unionByName(parts[1]))
    each = docs.select(F.col(key).alias("_id"), text_of(text).alias("_text"))
    size = each.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("_size"), F.first("_hash").alias("_hash")).orderBy("_hash", "_id").collect()
    ends = np.cumsum([r["_size"] for r in size])
    within = [r["_id"] for r in size[: int(np.searchsorted(ends, most, "right"))]]
    chosen = chosen if len(within) == len(size) else chosen.where(F.col("_id").isin(within))
    rows = each.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    got = sorted(rows.collect(), key=lambda r: r["_id"])
    return fit([r["_text"] for r in got], [r["_label"] for r in got])


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score (0 to 1), predicted (1 from 0.5 on) and offending, the sentences that score 0.5 or more, of every whole text.

    A null or empty text has no sentence and scores 0. Repeated rows stay, other columns are dropped, an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def work(b: dict[str, list]) -> dict[str, list]:
            got = [model.score(t) for t in b["text"]]
            return {"key": b["key"], "score": [s for s, _ in got], "predicted": [int(s >= 0.5) for s, _ in got], "offending": [x for _, x in got]}

        return work

    return map_rows(docs.select(docs[key].alias("key"), text_of(text).alias("text")), f"key {kind}, score double, predicted int, offending {SPANS}", make).withColumnRenamed("key", key)


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text is not predicted to be toxic."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        def work(b: dict[str, list]) -> dict[str, list]:
            kept = [i for i, t in enumerate(b[text]) if model.score(t or "")[0] < 0.5]
            return {k: [v[i] for i in kept] for k, v in b.items()}

        return work

    return map_rows(docs, schema, make)

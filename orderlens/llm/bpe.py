"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that lies inside no vocabulary token can never be merged across, so a cut between two characters whose last and first byte are such a pair is
certain, with two exceptions that are never taken, because the vocabulary's pre-tokeniser would see another text: a cut behind white space (a run of it is split by what
follows) and a cut beside an apostrophe (which may begin a contraction). Everywhere else the pre-tokeniser's pieces are the same on both sides of the cut as in the whole
text, or a piece of letters, digits or signs is cut where nothing merges. Texts are cut at all those places, each fragment is encoded by itself (once for each distinct
fragment that a worker still remembers) and the ids are concatenated.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, text_of

#: Bytes of fragments that a worker remembers (each counted with OVERHEAD bytes more), and the longest fragment that it does.
REMEMBERED, OVERHEAD, LONGEST = 24_000_000, 160, 48
#: Bytes of a text that are cut at once, and fragments that are encoded at once, so that a text of any length is encoded in bounded memory.
STRETCH, BLOCK = 1 << 20, 65_536
#: Characters of a fragment, without a single space between others, from which on it is left to the library.
LONG = 400
#: A single space between characters that are not white: it always begins a piece. Python's white space holds all that the pre-tokeniser's does.
SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Fixed value: the pattern by which the vocabulary's pre-tokeniser finds pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Last bytes of white space in UTF-8, and of the apostrophe: no cut behind them. Some other characters end with such a byte too, which only costs a cut.
KEEP_BEHIND = frozenset([*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, 0x27])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in own}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return letters


class Vocabulary:
    """The bytes of each id, the special strings, and between which byte pairs a cut is certain."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {**spec["model"]["vocab"], **self.special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        #: Whether ids grow with the order of merges, so that ids serve as merge ranks.
        self.ranked = len(made) + 256 == len(spec["model"]["vocab"]) and all(a < b for a, b in zip(made, made[1:], strict=False)) and not spec["normalizer"]
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            if token not in self.special and len(b := self.bytes[i]) > 1:
                a = np.frombuffer(b, np.uint8)
                inside[a[:-1], a[1:]] = True
        #: Whether a cut between two bytes is certain; never inside a character.
        self.certain = ~inside
        self.certain[sorted(KEEP_BEHIND)] = False
        self.certain[:, 0x27] = False
        self.certain[:, 0x80:0xC0] = False


class Encoder:
    def __init__(self, path: str) -> None:
        self.path, self.vocabulary, self.made = path, Vocabulary(path), None
        self.ordinary = self.by_rank() if self.vocabulary.ranked else None
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None

    def by_library(self, fragment: str) -> list[int]:
        if self.made is None:  # few texts need it
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_file(self.path)
            self.made.no_truncation()
            self.made.no_padding()
        return self.made.encode(fragment, add_special_tokens=False).ids

    def by_rank(self):
        """The same ids by merge ranks, with less work for each call."""
        import tiktoken

        special = set(self.vocabulary.special.values())
        ranks = {b: i for i, b in enumerate(self.vocabulary.bytes) if i not in special}
        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def merge(self, fragment: str) -> list[int]:
        """By merge ranks if there are any; a long fragment is cut at its single spaces first, and only parts that are long still need the library, whose tables take more memory than all others."""
        if self.ordinary is None:
            return self.by_library(fragment)
        if len(fragment) <= LONG:
            return self.ordinary(fragment)
        return [i for part in SPACE.split(fragment) for i in (self.ordinary(part) if len(part) <= LONG else self.by_library(part))]

    def fragments(self, raw: bytes) -> Iterator[list[bytes]]:
        """The text's bytes, cut at all certain places, in lists of at most BLOCK fragments."""
        start, size = 0, STRETCH
        while start < len(raw):
            part = np.frombuffer(raw, np.uint8, min(size, len(raw) - start), start)
            cuts = (np.flatnonzero(self.vocabulary.certain[part[:-1], part[1:]]) + start + 1).tolist()
            if start + size >= len(raw):
                cuts.append(len(raw))
            elif not cuts:  # one fragment is longer
                size *= 2
                continue
            for at in range(0, len(cuts), BLOCK):
                ends = cuts[at : at + BLOCK]
                yield [raw[a:b] for a, b in zip([start, *ends], ends, strict=False)]
                start = ends[-1]
            size = STRETCH

    def encode_fragments(self, fragments: list[bytes]) -> bytes:
        known = self.known
        missing = [f for f in set(fragments) if f not in known]
        if missing:
            if self.held > REMEMBERED:
                known.clear()
                self.held = 0
                missing = list(set(fragments))
            for f in missing:
                ids = self.merge(f.decode("utf-8", "surrogatepass"))
                known[f] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join([known[f] for f in fragments])
        for f in missing:
            if len(f) > LONGEST:
                del known[f]
            else:
                self.held += OVERHEAD + len(f) + len(known[f])
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            if part in self.vocabulary.special:
                out.append(struct.pack("<I", self.vocabulary.special[part]))
            elif part:
                out += [self.encode_fragments(some) for some in self.fragments(part.encode("utf-8", "surrogatepass"))]
        return b"".join(out)


def decode_ids(table: list[bytes], ids: bytes) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """key, the columns to keep, and ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    A null or empty text has no ids. Special strings in a text become their ids. Null ids and repeated rows stay, other columns are dropped, an empty table gives an empty one.
    """
    keep = keep or []
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def make():
        encoder = Encoder(path)
        return lambda b: {c: b[c] for c in (key, *keep)} | {"ids": [encoder.encode(t) for t in b["_text"]]}

    return map_rows(docs.select(key, *keep, text_of(text).alias("_text")), f"{schema}, ids binary", make)


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, ids and the decoded text of rows that encode() made; special ids give their strings. Null ids give the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def make():
        table = Vocabulary(path).bytes  # the rest of it goes
        return lambda b: {"key": b["key"], "ids": b["ids"], "decoded": [decode_ids(table, x or b"") for x in b["ids"]]}

    return map_rows(encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")), f"key {kind}, ids binary, decoded string", make).withColumnRenamed("key", key)

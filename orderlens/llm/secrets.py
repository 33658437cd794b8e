"""Secret scans: three fixed patterns, and the cost of guessing for values that stand in a credential's place.

The cost is the least sum, over all ways to cut a value into spans, of the log10 of the guesses that each span takes: a common word, a date or year, a repeated
unit, a keyboard walk, a run of the alphabet or of digits, speech, or brute force over the alphabet of the whole value. A value of at least `threshold` is a secret.
The words are the fixed ones that guessers try first, then those that the corpus itself has most often.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush
from math import inf, log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, map_rows, most_frequent, tables, text_of

KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: A value after a name that contains a credential word, with or without the scheme of an authorization before it, or after "Bearer" alone.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization|credential|bearer)[A-Za-z0-9_-]{0,32}["']?\x20{0,3}(?:[:=]|=>|->|is\x20)\x20{0,3}["'`]?(?:(?:bearer|basic|token|apikey)\x20{1,3}["'`]?)?|(?<![A-Za-z0-9])bearer\x20{1,3}["'`]?)([!-~]{8,})""",
    re.I | re.A,
)
#: A text without any of these has neither an assignment nor a credential's place.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"authorization", b"credential", b"bearer")

# Words that guessers try first, in the order of their frequency.
COMMON = """123456 password qwerty admin welcome letmein dragon master monkey login abc iloveyou football baseball shadow michael jennifer
superman princess sunshine hello charlie secret freedom whatever trustno user test guest root default changeme example sample placeholder
password1 pass token key value string none null true false undefined your insert here xxxx todo the and for that with this from are was
summer winter spring autumn love money computer internet server database system access private public development production""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@!", "aeoistsai")
DATES = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:[12]\d|3[01]|0?[1-9]))|(?:(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)\d\d)")
YEARS = re.compile(r"(?:19|20)\d\d")
#: The longest word, walk or span of speech; a longer walk or speech costs more than any threshold in use, so cutting it changes nothing.
SPAN = 32
#: Words of the corpus that are known besides the fixed ones, at most; what such a word is; how often it must occur.
WORDS, WORD, OFTEN = 20_000, re.compile(rb"(?<![0-9a-z_\x80-\xff])[a-z]{3,24}(?![0-9a-z_\x80-\xff])"), 5
#: A value that refers to one kept elsewhere: a variable, a template's place, a call or subscript, names joined by dots.
REFERENCE = re.compile(r"""\$[\w{(]|<[A-Za-z]|\{\{|%[({]|[A-Za-z_]+(?:\.[A-Za-z_]+)*(?:\[.*\]|\(.*\))|[A-Za-z_]{2,24}(?:\.[A-Za-z_]{2,24})+$""", re.S)
REPEATS = [re.compile(rf"(.{{{u}}})\1+", re.S) for u in range(1, 9)]


def beside() -> set[tuple[str, str]]:
    """Keys that touch on the keyboard, in both directions."""
    at = {c: (r, i + r / 2) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {(a, b) for a, (r, x) in at.items() for b, (s, y) in at.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1}


BESIDE = beside()


#: Letters of one case in a row that have a vowel, and nowhere five consonants in a row, are taken for speech, which has less choice a letter.
SPEECH = re.compile(r"[A-Z]?[a-z]{3,31}|[A-Z]{4,32}")
VOWELS, CONSONANTS = frozenset("aeiouyAEIOUY"), 5
#: The least length of speech; log10 of the guesses for a letter of it, for the choice of its kind and length within a value, for a sign between letters, and for each cut.
LEAST_SPEECH, LETTER, KIND, JOINT, CUT = 4, 0.75, log10(4 * 8), 1.0, 0.3


def alphabet(value: str) -> int:
    """The number of characters of the kinds that a value has."""
    return max(26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 20 * bool(re.search("[^A-Za-z0-9]", value)), 2)


def spans_at(value: str, low: str, plain: str, i: int, choice: float, ranks: dict[str, int]) -> list[tuple[int, float]]:
    """Every span with structure that begins at i: its end and log10 of its guesses. choice: log10 of the choice for a character without structure."""
    found, n = [], len(value)
    if m := SPEECH.match(value, i):
        hard, vowel = 0, False
        for j in range(i, m.end()):
            vowel, hard = (True, 0) if value[j] in VOWELS else (vowel, hard + 1)
            if hard == CONSONANTS:
                break
            if vowel and j + 1 - i >= LEAST_SPEECH:
                found.append((j + 1, LETTER * (j + 1 - i) + KIND * (j + 1 - i < n)))
    if value[i] in "_-./:" and 0 < i < n - 1 and value[i - 1].isalpha() and value[i + 1].isalpha():
        found.append((i + 1, JOINT))
    for j in range(i + 3, min(n, i + SPAN) + 1):
        rank = min((ranks[w] for w in (low[i:j], plain[i:j]) if w in ranks), default=0)
        if rank:
            found.append((j, log10(rank + 1) + 0.3 * (value[i:j] != low[i:j]) + 0.3 * (low[i:j] not in ranks)))
    for pattern, cost in ((DATES, log10(365 * 120)), (YEARS, log10(120))):
        if m := pattern.match(value, i):
            found.append((m.end(), cost))
    for unit, pattern in enumerate(REPEATS, 1):
        if (m := pattern.match(value, i)) and m.end() >= i + max(3, 2 * unit):
            found.append((m.end(), choice * unit + log10((m.end() - i) / unit)))
    for same in (lambda a, b: (a, b) in BESIDE, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(b) - ord(a) == -1):
        j = i + 1
        while j < min(n, i + SPAN) and same(low[j - 1], low[j]):
            j += 1
        if j >= i + 4:
            found.append((j, log10(47) + 0.35 * (j - i)))
    return found


def guess_cost(value: str, ranks: dict[str, int] | None = None, limit: float = inf) -> float:
    """log10 of the guesses that the cheapest segmentation takes; each further span costs as much as choosing where it starts.

    Only whether the cost reaches `limit` counts: the search goes on from places that cost less alone, and ends as soon as there is none (infinity) or the end is reached for less.
    """
    n, ranks = len(value), RANK if ranks is None else ranks
    low, choice = value.lower(), log10(alphabet(value))
    plain = low.translate(LEET)
    best, brute = {0: 0.0}, {}  # of prefixes; brute: those that end in a span without structure
    places = [0]
    while places:
        i = heappop(places)
        if i == n:
            return best[n]
        if limit < inf and best.get(n, inf) < limit:
            return best[n]
        cut = best[i] + CUT * (i > 0)
        brute[i + 1] = min(brute.pop(i, inf), cut) + choice
        for j, cost in [(i + 1, brute[i + 1] - cut), *spans_at(value, low, plain, i, choice, ranks)]:
            if cut + cost < min(limit, best.get(j, inf)):
                if j not in best:
                    heappush(places, j)
                best[j] = cut + cost
    return inf


def words_of(text: str) -> list[bytes]:
    """The words of a text but for what stands in a credential's place."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(h in raw for h in HINTS):
        raw = CONTEXT.sub("=", text).encode("utf-8", "surrogatepass").lower()
    return WORD.findall(raw)


def learn_ranks(docs: DataFrame, text: str = "text", words: int = WORDS) -> dict[str, int]:
    """The rank of each word that guessers try: the fixed ones, then the most frequent of all texts. At most `words` of 24 letters come to the driver."""
    with tables(docs.sparkSession) as keep:
        counts = keep(counted(docs.select(text_of(text).alias("text")), words_of).where(F.col("c") >= OFTEN))
        found = most_frequent(counts, words).collect()
    ranks = dict(RANK)
    for r in sorted(found, key=lambda r: (-r.c, r.word)):
        ranks.setdefault(bytes(r.word).decode(), len(ranks) + 1)
    return ranks


def find(text: str, threshold: float = 10.0, ranks: dict[str, int] | None = None) -> list[dict]:
    """All spans of a text by start, then by kind in the order of KINDS; offsets are code points, ends exclusive."""
    spans = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    hinted = any(h in raw for h in HINTS)
    if hinted:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if hinted:
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip("\"'`.,;:)]}>")
            if len(value) >= 8 and not REFERENCE.match(m[1].rstrip("\"'`.,;:")) and guess_cost(value, ranks, threshold) >= threshold:
                spans.append((m.start(1), 3, m.start(1) + len(value)))
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 10.0, ranks: dict[str, int] | None = None) -> DataFrame:
    """key and spans of every whole text; ranks from learn_ranks(), else the fixed words alone.

    A null or empty text has no spans (an empty array). Null ids and repeated rows stay, other columns are dropped, an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        known = shared.value
        return lambda b: {"key": b["key"], "spans": [find(t, threshold, known) for t in b["text"]]}

    return map_rows(docs.select(docs[key].alias("key"), text_of(text).alias("text")), f"key {kind}, spans {SPANS}", make).withColumnRenamed("key", key)


def masked(text: str | None, threshold: float, mask: str, ranks: dict[str, int] | None = None) -> str | None:
    if not text:
        return text
    parts, done, until = [], 0, -1
    for s in find(text, threshold, ranks):
        if s["start"] >= until:
            parts += [text[done : s["start"]], mask]
        until = done = max(until, s["end"])
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, text: str = "text", threshold: float = 10.0, mask: str = "[SECRET]", ranks: dict[str, int] | None = None) -> DataFrame:
    """All columns and rows of docs; in text each span, or run of overlapping spans, is replaced by the mask. Null and empty texts stay as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        known = shared.value
        return lambda b: b | {text: [masked(t, threshold, mask, known) for t in b[text]]}

    return map_rows(docs, schema, make)

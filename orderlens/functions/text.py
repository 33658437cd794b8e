"""Scalar functions on text, identifiers, grades and probabilities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation and the articles that answer normalisation drops.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"\b(a|an|the)\b"


def collapsed(text: Column, n: int | None = None) -> Column:
    """White space runs as one space, ends trimmed; the first n characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return flat if n is None else F.substring(flat, 1, n)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def rounded_brackets(text: Column) -> Column:
    """[N] as (N)."""
    return F.regexp_replace(text, r"\[(\d+)\]", "($1)")


def permutation(text: Column, n: int) -> Column:
    """The order that a reply like `[2] > [1]` gives of n items, 0-based: numbers in range, first mention only, then the rest in order."""
    said = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int") - 1)
    return F.array_union(F.array_distinct(F.filter(said, lambda x: (x >= 0) & (x < n))), F.sequence(F.lit(0), F.lit(n - 1)))


def grade(text: Column) -> Column:
    """The first digit 0 to 3 that stands alone."""
    return F.regexp_extract(text, r"(?<![\d.])([0-3])(?![\d.])", 1).try_cast("int")


def fraction(text: Column) -> Column:
    """The first number from 0 to 1 that stands alone."""
    return F.regexp_extract(text, r"(?<![\d.])(0(?:\.\d+)?|1(?:\.0+)?|\.\d+)(?![\d.])", 1).try_cast("double")


def score_lines(text: Column) -> Column:
    """A map from the document numbers to the scores of lines like `[1]: 2.5`."""
    found = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]\s*[:=]\s*(-?\d+(?:\.\d+)?)"), F.lit(0))
    pair = lambda x: F.struct(F.regexp_extract(x, r"\[(\d+)\]", 1).cast("int").alias("k"), F.regexp_extract(x, r"[:=]\s*(-?\d+(?:\.\d+)?)", 1).cast("double").alias("v"))
    return F.map_from_entries(F.transform(found, pair))


def grade_of(score: Column, cuts: list[float]) -> Column:
    """How many cuts a score reaches."""
    return sum((F.when(score >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def path_safe(qid: Column) -> Column:
    return F.replace(qid, F.lit("/"), F.lit("__SLASH__"))


def path_restored(name: Column) -> Column:
    return F.replace(name, F.lit("__SLASH__"), F.lit("/"))


def stable_seed(*parts: Column) -> Column:
    """The first eight bytes, big-endian, of the SHA-256 of the parts joined by NUL; DECIMAL(20,0), as it may not fit a BIGINT."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_rate(key: Column) -> Column:
    """A number in [0, 1) from the SHA-1 of the key, for sampling: keep where it is below the rate."""
    return F.conv(F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def simplex(p: Column) -> Column:
    """Negative entries as 0, and all divided by their sum; the even distribution if nothing is left."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(clipped, lambda x: x / total)).otherwise(F.transform(p, lambda x: 1.0 / F.size(p)))


def calibrated(p: Column, prior: Column, strength: float) -> Column:
    """p moved away from what a prior adds to the even distribution, by strength times p's entropy."""
    a = strength * entropy(p)
    return simplex(F.zip_with(p, prior, lambda x, q: x - a * (q - 1.0 / F.size(p))))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def expected_grade(p: Column) -> Column:
    """Sum of g * p by the highest grade, so from 0 to 1."""
    return F.aggregate(F.transform(p, lambda x, g: x * g), F.lit(0.0), lambda s, x: s + x) / (F.size(p) - 1)


def scalars(p: Column) -> dict[str, Column]:
    """The six readings of a vector of four grade probabilities."""
    top = F.array_position(p, F.array_max(p)) - 1
    at = lambda i: F.get(p, F.lit(i))
    return {
        "expected": expected_grade(p), "ordinal": (top + F.array_max(p)) / 4, "argmax": top / 3, "binary": at(2) + at(3), "very": at(3), "gain": (at(1) + 3 * at(2) + 7 * at(3)) / 7,
    }


def yes_probability(yes: Column, no: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def half_up(x: Column, places: int = 3) -> Column:
    return F.round(x.cast("decimal(38,18)"), places)


def normalized_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " "), r"\s+", " "))


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1))


def redacted(config: Column, keys: str = "key|token|secret|password") -> Column:
    """A JSON object's string values masked where the name says that they are secret."""
    return F.regexp_replace(config, rf'("(?:[^"]*(?:{keys})[^"]*)"\s*:\s*)"[^"]*"', '$1"***"')


def roman(n: Column) -> Column:
    """Numbers from 1 to 39."""
    digit = lambda d, one, five, ten: F.when(d == 9, one + ten).when(d >= 5, F.concat(F.lit(five), F.repeat(F.lit(one), (d - 5).cast("int")))).when(d == 4, one + five).otherwise(F.repeat(F.lit(one), d.cast("int")))
    return F.concat(F.repeat(F.lit("X"), F.floor(n / 10).cast("int")), digit(n % 10, "I", "V", "X"))

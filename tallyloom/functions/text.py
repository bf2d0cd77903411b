"""Native expressions for short texts: words, trigrams, amounts and the distances between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search. Fixed values.
STOP_WORDS = (
    "a", "about", "all", "and", "any", "did", "do", "ever", "find", "for", "from", "i", "in", "info", "last", "latest", "mention", "mentions", "mentioned", "most", "my",
    "note", "notes", "of", "on", "our", "recent", "recently", "save", "saved", "search", "show", "that", "the", "what", "which",
)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's argument is evaluated once, an expression wherever it stands."""
    return F.transform(F.array(value), use)[0]


def normalise(col: str | Column) -> Column:
    """Lower case, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), r"\s+", " "))


def search_form(col: str | Column) -> Column:
    """Lower case with anything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", " "))


def search_words(col: str | Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Words of the search form of at least three letters, or with a digit, but no stop words; repeats stay."""
    return F.filter(F.split(search_form(col), " "), lambda w: ~w.isin(*stop) & ((F.length(w) >= 3) | F.regexp_like(w, F.lit("[0-9]"))))


def word_set(col: str | Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(_c(col)), r"[\s\p{Punct}]+")), lambda w: w != "")


def trigrams(col: str | Column) -> Column:
    """The set of three-letter pieces of the search form; a shorter text is its own piece."""

    def of(t: Column) -> Column:
        n = F.length(t)
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= 3, F.array(t)).otherwise(F.array_distinct(pieces))

    return bound(search_form(col), of)


def jaccard(a: Column, b: Column) -> Column:

    def of(p: Column) -> Column:
        union = F.size(F.array_union(p["a"], p["b"]))
        return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / union)

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def first_upper(col: str | Column) -> Column:
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def split_items(col: str | Column) -> Column:
    """Items of a list in one line: commas (not between digits), semicolons, bars, ampersands and 'and' between them."""
    parts = F.split(_c(col), r"(?:(?<!\d),|,(?!\d)|[;|&\n])|\s+and\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))), lambda p: p != "")


def amount(col: str | Column) -> Column:
    """Number a money text means: currency signs, thousands commas and a closing '/-' apart, with k, lakh (l) and crore as
    factors; null where there is none."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(col))), r"^(?:rs\.?|inr|₹|\$|€)\s*", ""), r"\s*(?:rs\.?|rupees|/-|₹|€|\$)$", "")
    number = F.regexp_extract(t, r"^(\d[\d,]*(?:\.\d+)?)\s*(k|l|lakh|lakhs|cr|crore|crores)?$", 1)
    unit = F.regexp_extract(t, r"^(\d[\d,]*(?:\.\d+)?)\s*(k|l|lakh|lakhs|cr|crore|crores)?$", 2)
    factor = F.when(unit == "k", 1e3).when(unit.isin("l", "lakh", "lakhs"), 1e5).when(unit.isin("cr", "crore", "crores"), 1e7).otherwise(1.0)
    return F.regexp_replace(number, ",", "").try_cast("double") * factor


def clamp(col: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col))


# Vectors ------------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is all zeros, or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((n == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def letter_vector(col: str | Column) -> Column:
    """How often each of the letters a to z occurs, as a unit vector; null without letters."""
    t = F.lower(_c(col))
    counts = F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(ch)))).cast("double") for ch in "abcdefghijklmnopqrstuvwxyz"])
    return F.when(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) > 0, unit(counts))

"""Column builders over text: words, n-grams, repetition, coherence. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; the regex class \s alone covers ASCII only.
WS = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]+"


def tokens(text: Column) -> Column:
    """Runs of anything but white space; an empty array for a blank or null text."""
    return F.coalesce(F.filter(F.split(text, WS), lambda x: x != ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return tokens(F.lower(text))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def _runs(ws: Column, n: int, sep: str) -> Column:
    """Runs of ``n`` words from ``n`` shifted slices: the words stay outside any lambda, where they would be computed for every element."""
    m = F.greatest(F.size(ws) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice(ws, k + 1, m).alias(f"w{k}") for k in range(n)))
    return F.transform(shifted, lambda x: F.concat_ws(sep, *(x[f"w{k}"] for k in range(n))))


def ngrams(ws: Column, n: int) -> Column:
    """All runs of ``n`` words in order, joined by \\x01; empty below ``n`` words."""
    return _runs(ws, n, "\x01")


def shingles(ws: Column, n: int) -> Column:
    """Runs of ``n`` words; a shorter text is one shingle of all its words."""
    return F.when(F.size(ws) < n, F.array(F.array_join(ws, " "))).otherwise(_runs(ws, n, " "))


def repetition(ws: Column, n: int = 3) -> Column:
    """Share of n-grams that repeat an earlier one: 1 - distinct / all, 0 below ``n`` words."""
    return F.when(F.size(ws) < n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(ngrams(ws, n))) / (F.size(ws) - (n - 1)))


def repeated_share(g: Column) -> Column:
    """Share of the distinct ones of sorted n-grams that occur more than once; 0 for none. ``g`` is best a column of its own."""
    n = F.size(g)
    pairs = F.arrays_zip(F.slice(g, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(g, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    twice = F.size(F.array_distinct(F.filter(F.transform(pairs, lambda x: F.when(x["a"] == x["b"], x["a"])), lambda x: x.isNotNull())))
    return F.when(n > 0, twice / F.size(F.array_distinct(g))).otherwise(0.0)


def sentence_sets(text: Column) -> Column:
    """The word set of every sentence that isn't blank."""
    return F.transform(F.filter(F.transform(F.split(text, "[.!?]+"), trimmed), lambda s: s != ""), lambda s: F.array_distinct(words(s)))


def coherence(sets: Column) -> Column:
    """Mean overlap of the word sets of adjacent sentences, 1 with fewer than two. ``sets`` is best a column of its own."""
    n = F.size(sets)
    m = F.greatest(n - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(sets, 1, m).alias("a"), F.slice(sets, 2, m).alias("b"))
    overlap = lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), F.size(F.array_intersect(x["a"], x["b"])) / F.least(F.size(x["a"]), F.size(x["b"]))).otherwise(0.0)
    return F.when(n < 2, F.lit(1.0)).otherwise(F.aggregate(F.transform(pairs, overlap), F.lit(0.0), lambda s, x: s + x) / (n - 1))


def count_contained(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    return sum((F.when(F.contains(text, F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0))


def contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)

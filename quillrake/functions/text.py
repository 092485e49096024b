"""Text functions: tokenizers and scores of single texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard English stop words; fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def _text(t: Column | str) -> Column:
    return F.col(t) if isinstance(t, str) else t


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; a plain reference inside a lambda is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column | str, analyzer: str = "standard") -> Column:
    """Terms of a text. ``whitespace``, ``identity``, ``standard`` (lower-case letters and digits), ``english`` (no stop words)."""
    t = _text(text)
    if analyzer == "identity":
        return F.array(t)
    if analyzer == "whitespace":
        return F.filter(F.split(t, r"\s+"), lambda w: w != "")
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if analyzer == "standard":
        return words
    if analyzer == "english":
        return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    raise ValueError(f"no analyzer {analyzer!r}")


def score_terms(text: Column | str) -> Column:
    """Terms of the corpus-free scores: split at white space, lower case, trimmed to letters and digits at both ends."""
    words = F.split(F.lower(_text(text)), r"\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def bm25_score(text: Column | str, query: Column | str) -> Column:
    """Sum over the query's terms, repeats included, of tf * 2.2 / (tf + 1.2); no corpus statistics."""
    wanted = score_terms(query if isinstance(query, Column) else F.lit(query))

    def scored(words: Column) -> Column:
        def part(q: Column) -> Column:
            return let(F.size(F.filter(words, lambda w: w == q)).cast("double"), lambda tf: tf * 2.2 / (tf + 1.2))

        return F.aggregate(F.transform(wanted, part), F.lit(0.0), lambda s, x: s + x)

    return let(score_terms(text), scored)


def tf_idf(text: Column | str) -> Column:
    """Share of each distinct term, in order of first appearance."""
    return let(score_terms(text), lambda words: F.transform(F.array_distinct(words), lambda t: F.size(F.filter(words, lambda w: w == t)) / F.size(words)))

"""Word and character n-grams as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.binding import let


def feature_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Words that enter word n-grams: more than one letter and no stop word.

    N-grams are built after this filter, so a bigram may span a removed word.
    """
    keep = F.filter(F.split(text, " "), lambda t: F.length(t) > 1)
    return F.filter(keep, lambda t: ~t.isin(*stopwords)) if stopwords else keep


def _spans(length: Column, n: int) -> Column:
    """Start positions 1..length-n+1, empty if the input is too short."""
    return F.when(length >= n, F.sequence(F.lit(1), length - (n - 1))).otherwise(
        F.array().cast("array<int>"))


def _word_spans(toks: Column, n: int) -> Column:
    if n == 1:
        return toks
    return F.transform(_spans(F.size(toks), n), lambda i: F.concat_ws(
        " ", *[toks[i + (j - 1)] for j in range(n)]))


def _char_spans(padded: Column, n: int) -> Column:
    return F.transform(_spans(F.length(padded), n), lambda i: F.substring(padded, i, n))


def counted(items: Column) -> Column:
    """array<struct<term, tf>> of an array of texts: sorted, then cut where the text changes."""
    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return F.when(F.size(items) > 0, let(F.sort_array(items), cut)).otherwise(
        F.array().cast("array<struct<term:string,tf:bigint>>"))


def word_ngrams(toks: Column, low: int, high: int) -> Column:
    """All n-grams of a token array, repeats kept."""
    return F.concat(*[_word_spans(toks, n) for n in range(low, high + 1)])


def char_ngrams(word: Column, low: int, high: int) -> Column:
    """All character n-grams of one word padded with a blank on each side."""
    return let(F.concat(F.lit(" "), word, F.lit(" ")), lambda padded: F.concat(
        *[_char_spans(padded, n) for n in range(low, high + 1)]))

"""Spelling variants: words that are one edit apart, found by pairs of numbered trie nodes.

A word cut after i signs is a pair of nodes: that of its first i signs in the trie of all words and
that of the rest in the trie of all reversed words.  Cut around a sign, the pair leaves that sign
out.  Two words differ in one replaced sign if they have the same pair around a sign, and by one
inserted sign if a pair around a sign of the longer is a pair of the shorter, so a join on pairs of
numbers gives the exact neighbours.  Nodes are told apart by 128-bit digests of their signs and then
numbered; a node that only one word passes can't be shared, so only the others get a number and only
positions with two numbered nodes are joined.  Words of one pair around a sign differ only in that
sign, so a group has at most as many words as the alphabet has signs, and one more.

A sign in a run of equal ones can be left out at several places with the same result; the first of
the run stands for all, so no neighbour is counted twice.

Words: runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, only A-Z in lower case.  Where 97
divides the crc32 of ``<doc_id>:<run>``, the run loses its sign at the crc32 modulo its length.

Defined results: null and empty texts give no words; a row without a doc_id has no crc32 and its
runs stay whole; repeated rows count again; a run of any length is one word, worked on in linear
space; of near words with equal counts the first in code-point order is taken; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.tables import documents, keyed_texts, query
from themeloom.session import materialize

DELETE_EVERY = 97
LEAST_SIGNS, LEAST_COUNT, FORM_FACTOR = 5, 3, 2
# Words that a task counts before it passes the counts on.
COUNTED = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of(doc_id: int | None, text: str, every: int = DELETE_EVERY) -> Iterator[tuple[str, int]]:
    """(word, n) for each distinct run of a document; a word can come from several."""
    for run, n in Counter(_RUN.findall(text)).items():
        run = run.lower() if run.isascii() else run.translate(_LOWER)
        if doc_id is not None:
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if not h % every:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        yield run, n


def vocabulary(docs: DataFrame, every: int = DELETE_EVERY, signs: int = LEAST_SIGNS,
               count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``signs`` signs that occur at least ``count`` times."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                    strict=True):
                for word, n in runs_of(doc_id, text.as_py(), every):
                    if len(word) >= signs:
                        seen[word] += n
                if len(seen) >= COUNTED:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    counts = keyed_texts(docs).mapInArrow(tally, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
        names=["word", "n"])


def _digests(signs: str) -> list[bytes]:
    """Digest of the first 0, 1, ... signs."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for sign in signs:
        state.update(sign.encode("utf-32-le"))
        out.append(state.digest())
    return out


def passed_nodes(words: DataFrame) -> DataFrame:
    """(id, prefix, rest, skip, first) of every place of a word, from its start to its end.

    ``prefix`` is the node of the signs before the place, ``rest`` that of those from there on,
    reversed, and ``skip`` that of those after the next sign (null at the end); ``first`` says that
    the sign before the place, if any, is another than the next.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for word_id, word in zip(batch.column("id").to_pylist(),
                                     batch.column("word").to_pylist(), strict=True):
                ends = _digests(word[::-1])[::-1]
                rows[0] += [word_id] * len(ends)
                rows[1] += _digests(word)
                rows[2] += ends
                rows[3] += [*ends[1:], None]
                rows[4] += [True, *(a != b for a, b in zip(word, word[1:], strict=False)), False]
                if len(rows[0]) >= COUNTED:
                    yield _places(rows)
                    rows = [[], [], [], [], []]
            yield _places(rows)

    return words.select("id", "word").mapInArrow(
        walk, "id long, prefix binary, rest binary, skip binary, first boolean")


def _places(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)],
        names=["id", "prefix", "rest", "skip", "first"])


def _numbered(places: DataFrame, node: str) -> DataFrame:
    """(digest, number) of the nodes that several words pass; a word passes a node once."""
    shared = places.groupBy(F.col(node).alias("digest")).count().filter("count > 1")
    return materialize(shared.select("digest", F.monotonically_increasing_id().alias("number")))


def pairs(words: DataFrame) -> DataFrame:
    """(p, s, id, whole, first): pairs of node numbers of each word (id, word), written.

    ``whole`` pairs are those of the word itself, the others leave out one sign.
    """
    places = materialize(passed_nodes(words))
    forward, backward = _numbered(places, "prefix"), _numbered(places, "rest")
    held = places.join(forward, places["prefix"] == forward["digest"]).select(
        "id", "rest", "skip", "first", F.col("number").alias("p"))
    ends = F.explode(F.array(
        F.struct(F.col("rest").alias("end"), F.lit(True).alias("whole")),
        F.struct(F.col("skip").alias("end"), F.lit(False).alias("whole")))).alias("e")
    held = held.select("id", "p", "first", ends).select("id", "p", "first", "e.*")
    return held.join(backward, held["end"] == backward["digest"]).select(
        "p", F.col("number").alias("s"), "id", "whole", "first")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): near words of each word (id, word, n) that has any.

    ``best`` is a struct of the greatest count, negated, and its word's id.  Ids rise in code-point
    order.
    """
    held = pairs(words).join(words.select("id", "n"), "id")
    member = F.struct((-F.col("n")).alias("less"), "id", "whole", "first")
    groups = held.groupBy("p", "s").agg(F.array_sort(F.collect_list(member)).alias("all"))
    groups = groups.filter(F.size("all") > 1)
    mine = groups.select("all", F.explode("all").alias("x"))

    def near(y):
        replaced = ~F.col("x.whole") & ~y["whole"] & (F.col("x.id") != y["id"])
        longer = ~F.col("x.whole") & F.col("x.first") & y["whole"]
        shorter = F.col("x.whole") & ~y["whole"] & y["first"]
        return replaced | longer | shorter

    found = mine.select("x.id", F.filter("all", near).alias("near")).filter(F.size("near") > 0)
    best = F.struct(F.col("near")[0]["less"].alias("less"), F.col("near")[0]["id"].alias("id"))
    return found.select("id", F.size("near").alias("k"), best.alias("best")).groupBy("id").agg(
        F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where following the forms (id, form) ends, for each id; written.

    Each round joins what has been followed so far with itself, so rounds are the logarithm of the
    longest chain; counts at least double along a chain, so it is short.
    """
    ahead = materialize(forms.select("id", F.col("form").alias("root")))
    while True:
        second = ahead.select(F.col("id").alias("root"), F.col("root").alias("far"))
        ahead = materialize(ahead.join(second, "root", "left").select(
            "id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if ahead.filter("moved").isEmpty():
            return ahead.select("id", "root")


def variants(counts: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts`` (word, n).

    ``form`` is the near word of largest n, if that is at least ``factor`` times the word's own.
    """
    words = materialize(counts.orderBy("word").select(
        F.monotonically_increasing_id().alias("id"), "word", "n"))
    linked = materialize(words.join(neighbours(words), "id").select(
        "id", "n", "n_near", F.col("best.id").alias("form"), (-F.col("best.less")).alias("form_n")))
    forms = linked.filter(F.col("form_n") >= factor * F.col("n")).select("id", "form", "form_n")
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    forms = forms.join(roots(forms), "id").join(named, "form").join(ends, "root").select(
        "id", "form_word", "root_word", "form_n")
    return words.join(linked.select("id", "n_near"), "id", "left").join(forms, "id", "left").select(
        "word", F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


@query
def op12_spelling_variants(spark, sf_dir):
    """Frequent words of all documents with their near words, forms and roots."""
    return variants(vocabulary(documents(spark, sf_dir)))

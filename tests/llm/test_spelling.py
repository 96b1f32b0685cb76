from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.brute import odd_documents
from themeloom.llm import spelling as op
from themeloom.llm.tables import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(rows, every=97, signs=5, count=3):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                cut = list(run)
                del cut[h % len(run)]
                run = "".join(cut)
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= signs and n >= count}


def near(a, b):
    """Exactly one inserted, deleted or replaced sign apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    """(word, form, root, n, n_near, form_n) by trying every edit of every word."""
    letters = sorted({c for w in words for c in w})
    forms, counts = {}, {}
    for w in words:
        tries = {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1)
                 for c in ("", *letters)}
        others = [v for v in tries if v in words and v != w and near(v, w)]
        counts[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, words[w], counts[w], words.get(forms[w])))
    return out


def as_set(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = as_set(QUERIES["op12_spelling_variants"](spark, sf))
    assert got == brute(words_of(rows))
    assert sum(r[1] is not None for r in got) > 100 and any(r[2] != r[1] and r[1] for r in got)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.dictionaries(st.text("abé", min_size=1, max_size=6), st.integers(1, 40),
                             min_size=1, max_size=60))
def test_dense_words(spark, words):
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_set(op.variants(counts)) == brute(words)


def test_one_group_and_runs_of_equal_signs(spark):
    words = {f"wor{chr(97 + i)}s": 3 + i for i in range(26)} | {"wors": 200, "worss": 7}
    words |= {"a" * n: 5 * n for n in range(5, 30)} | {"×÷×÷×": 3, "×÷×÷÷×": 6, "ÿÿÿÿÿ": 4}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    got = as_set(op.variants(counts))
    assert got == brute(words)
    assert {r[0]: r[4] for r in got}["words"] == 26


@pytest.mark.parametrize("every", [97, 3])
def test_odd_rows(spark, every):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    extra = [(8, "STRASSE straße Straße strasse Ünder ünder Únder " * 3), (None, "whole Whole wHole "),
             (9, ("y" * 4000 + " ") * 5 + ("y" * 4001 + " ") * 3)]
    more = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    counts = op.vocabulary(more, every)
    want = words_of([*rows, *extra], every)
    assert {r.word: r.n for r in counts.collect()} == want
    long = {w for w in want if len(w) > 3000}
    got = as_set(op.variants(counts))
    assert {r for r in got if r[0] not in long} == brute(
        {w: n for w, n in want.items() if w not in long})
    assert {(r[0], r[4]) for r in got if r[0] in long} == {
        (w, sum(near(w, v) for v in long)) for w in long}
    assert op.variants(op.vocabulary(odd_documents(spark, empty=True))).count() == 0

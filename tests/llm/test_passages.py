from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import odd_documents
from themeloom.llm import passages as op
from themeloom.llm.tables import QUERIES


def runs_shared(texts, n=50):
    """(doc_id, first word) of all runs of n words that a document of lesser id has too."""
    first, out = {}, set()
    for d in sorted(texts):
        own = (texts[d] or "").encode().lower().split()
        for i in range(len(own) - n + 1):
            if first.setdefault(tuple(own[i:i + n]), d) != d:
                out.add((d, i))
    return out


def covers(rows, wanted, n=50):
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.start_word + r.n_words))
    return [(d, i) for d, i in wanted
            if not any(a <= i and i + n <= b for a, b in spans.get(d, []))]


def test_query_covers_all_equal_runs(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op8_substring_dedup"](spark, sf).collect()
    wanted = runs_shared(texts)
    assert wanted and not covers(rows, wanted)
    for r in rows:
        assert r.n_words >= 50 and r.similarity >= 0.8 and r.other_id < r.doc_id


def mosaic():
    """Documents of common pieces, changed here and there."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    pieces = [draw.choices(words, k=draw.randrange(15, 120)) for _ in range(12)]
    texts = {}
    for d in range(40):
        own = []
        for _ in range(draw.randrange(1, 5)):
            own += draw.choices(words, k=draw.randrange(30))
            piece = list(draw.choice(pieces))
            if draw.random() < 0.3:
                piece[draw.randrange(len(piece))] = "changed"
            own += piece
        texts[d] = " ".join(own)
    return texts


def test_mosaic(spark):
    texts = mosaic()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = op.shared_passages(docs).collect()
    wanted = runs_shared(texts)
    assert wanted and not covers(rows, wanted)
    left = dict(op.cut_repeats(docs).select("doc_id", "text").collect())
    assert not runs_shared(left)
    assert left[0] == texts[0]
    for r in rows:  # what a passage names is alike in both
        a = texts[r.doc_id].split()[r.start_word:r.start_word + r.n_words]
        b = texts[r.other_id].split()[r.other_start:r.other_start + r.other_words]
        assert op._common(a, b) >= r.equal_words


def test_fuzzy_passage():
    draw = random.Random(3)
    a = [str(draw.randrange(10 ** 6)) for _ in range(90)]
    b = list(a)
    b[20], b[45:46], b[70] = "x", ["y", "z"], "u"
    seeds = np.array([3, 28, 75])
    found = op.passages_of(["p"] * 7 + a + ["q"] * 9, b, np.append(seeds[:2] + 7, 82),
                           np.append(seeds[:2], 76), 50, 0.8)
    assert [(p.start, p.words, p.other_start, p.other_words, p.equal) for p in found] == [
        (7, 90, 0, 91, 87)]


@pytest.mark.parametrize("size, every, least", [(60, 20, 0.98), (60, 12, 0.9), (60, 10, 0.88),
                                                (100, 12, 0.98), (100, 10, 0.96)])
def test_planted_fuzzy_passages(spark, size, every, least):
    """Pairs of documents that share a passage with a word replaced every few words."""
    draw = random.Random(size + every)
    text = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    rows = []
    for i in range(200):
        piece = text(size)
        for own in (piece, [f"new{draw.randrange(10 ** 6)}" if j % every == every // 2 else w
                            for j, w in enumerate(piece)]):
            rows.append((len(rows), " ".join(text(40) + own + text(40))))
    found = op.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.other_id == r.doc_id - 1 and r.doc_id % 2 for r in found)
    assert len({r.doc_id for r in found}) >= least * 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=23, max_size=48), st.data())
def test_may_extend_loses_none(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 9))):
        i = data.draw(st.integers(0, len(b) - 1))
        b[i:i + data.draw(st.integers(0, 1))] = [data.draw(st.integers(0, 9))]
    b = b[:op.AROUND]
    x, y = (np.array(v, dtype="<u2").tobytes() for v in (a, b))
    assert op.may_extend(x, y, 23) or op.extend(a, b, 0, 0, 1)[0] < 23


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=9,
                unique=True))
def test_best_chain(points):
    parts = [op.Segment(x, y, 3) for x, y in points]

    def best(i):  # over all predecessors
        s = parts[i]
        return s.n + max([0] + [best(j) - op.GAP_COST * (
            s.x - e.x - e.n + s.y - e.y - e.n) for j, e in enumerate(parts)
            if e.x + e.n <= s.x and e.y + e.n <= s.y])

    chain = op.chains(parts)[0]
    score = sum(s.n for s in chain) - op.GAP_COST * sum(
        t.x - s.x - s.n + t.y - s.y - s.n for s, t in zip(chain, chain[1:], strict=False))
    assert score == pytest.approx(max(map(best, range(len(parts)))))
    assert sorted(s for c in op.chains(parts) for s in c) == sorted(parts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=4))
def test_every_window_has_a_seed(rows):
    first = np.cumsum([0, *map(len, rows)])
    hashes = np.array([x * 7919 + 1 for r in rows for x in r], dtype=np.uint64)
    place, _ = op.minimizers(hashes, first, 5, 16)
    for i, row in enumerate(rows):
        own = place[(place >= first[i]) & (place < first[i + 1])] - first[i]
        n = len(row) - 4
        assert (own < max(n, 0)).all()
        for s in range(max(n - 15, min(n, 1) if n > 0 else 0)):
            assert ((own >= s) & (own < s + 16)).any()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.shared_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(8, 7), (6, 5)}
    kept = op.cut_repeats(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    left = {r.doc_id: r for r in kept.collect()}
    assert kept.count() == docs.count() - 1 and 6 not in left
    assert left[8].text == "another beginning and ending" and left[8].n_chars == 28
    assert left[0].text is None and left[None].text == "no id here"
    assert left[None].n_chars is None and left[3] == docs.filter("doc_id = 3").first()
    empty = odd_documents(spark, empty=True)
    assert op.shared_passages(empty).count() == 0 and op.cut_repeats(empty).count() == 0

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.brute import odd_documents
from tests.llm.test_passages import runs_shared
from themeloom.llm import near_copies as op
from themeloom.llm import passages
from themeloom.llm.scan import mix
from themeloom.session import materialize


def shingles(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def least_ids(texts, similarity=0.8):
    """Least id of the class of each text, over all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in texts:
            if b < a and (sets[a] == sets[b] or len(sets[a] & sets[b])
                          >= similarity * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def edited():
    """Texts of 200 words with copies in which one to five words are replaced, and chains."""
    draw = random.Random(4)
    texts = {}
    for _ in range(25):
        base = [f"w{draw.randrange(10 ** 5)}" for _ in range(200)]
        for changes in (0, 1, 2, 3, 4, 5):
            own = list(base)
            for at in draw.sample(range(200), changes):
                own[at] = f"new{draw.randrange(10 ** 6)}"
            texts[len(texts)] = " ".join(own)
            if changes == 3:
                base = own
    return texts


def test_against_all_pairs(spark):
    texts = edited()
    want = least_ids(texts)
    kept = op.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert len(set(want.values())) < len(texts) / 3
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    kept = materialize(corpus_pipeline.near_duplicates(spark, docs, sf))
    assert {r.doc_id for r in kept.collect()} == set(least_ids(texts).values())
    single = dict(kept.select("doc_id", "text").collect())
    cut = dict(corpus_pipeline.repeated_passages(spark, kept, sf).select(
        "doc_id", "text").collect())
    assert not runs_shared(cut) and set(cut) <= set(single)
    shared = {d for d, _ in runs_shared(single)}
    assert shared and all(cut.get(d) != single[d] for d in shared)


def test_crowded_bands(spark):
    """Many unlike texts share most of their words; pairs stay few and near copies are found."""
    draw = random.Random(9)
    common = [f"c{i}" for i in range(120)]
    texts = {}
    for i in range(400):
        own = [f"o{draw.randrange(10 ** 6)}" for _ in range(45)]
        texts[2 * i] = " ".join([*common, *own])
        own[draw.randrange(40)] = "other"
        if i % 4 == 0:
            texts[2 * i + 1] = " ".join([*common, *own])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = op.candidates(materialize(op.signatures(docs)))
    assert pairs.count() <= len(texts) * op.BANDS * op.NEAREST
    kept = {r.doc_id for r in op.keep_one(docs).collect()}
    want = set(least_ids(texts).values())
    assert want <= kept and len(kept - want) <= 0.02 * len(texts)


def test_crowded_bands_are_compared_whole(spark, monkeypatch):
    """With four bands of one minimal hash most pairs only share crowded bands; all are compared, in
    however many blocks a band meets."""
    draw = random.Random(9)
    common = [f"c{i}" for i in range(150)]
    texts = {}
    for i in range(100):
        own = [f"o{draw.randrange(10 ** 6)}" for _ in range(42)]
        texts[2 * i] = " ".join([*common, *own])
        for at in (5, 15, 25, 35):
            own[at] = f"p{draw.randrange(10 ** 6)}"
        texts[2 * i + 1] = " ".join([*common, *own])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def minimal(shingles, first):
        return np.stack([np.minimum.reduceat(mix(shingles ^ np.uint64(j)), first[:-1])
                         for j in range(4)], axis=1)

    monkeypatch.setattr(op, "BANDS", 4)
    monkeypatch.setattr(op, "bands_of", minimal)
    monkeypatch.setattr(op, "BLOCK", 20, raising=False)
    assert {r.doc_id for r in op.keep_one(docs).collect()} == set(range(0, 200, 2)) == set(
        least_ids(texts).values())


def test_recall_of_near_copies(spark):
    """Planted pairs from 0.8 to 0.95, beside a large group of near copies."""
    draw = random.Random(2)
    texts, pairs = {}, []
    base = [f"g{i}" for i in range(150)]
    for i in range(300):
        own = list(base)
        own[draw.randrange(150)] = f"x{i}"
        texts[i] = " ".join(own)
    for changes in (1, 2, 3, 4):
        for _ in range(60):
            own = [f"w{draw.randrange(10 ** 6)}" for _ in range(200)]
            other = list(own)
            for at in draw.sample(range(200), changes):
                other[at] = f"new{draw.randrange(10 ** 6)}"
            first = len(texts)
            texts[first], texts[first + 1] = " ".join(own), " ".join(other)
            if len(shingles(texts[first]) & shingles(texts[first + 1])) >= 0.8 * len(
                    shingles(texts[first]) | shingles(texts[first + 1])):
                pairs.append(first + 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in op.keep_one(docs).collect()}
    assert kept & set(range(300)) == {0}
    assert len(pairs) > 200 and sum(d in kept for d in pairs) <= 0.01 * len(pairs)


def test_repeated_ids(spark):
    """Different texts with one id are rows of their own; equal rows are one."""
    unlike = [" ".join(f"{c}{i}" for i in range(120)) for c in "abc"]
    rows = [(1, unlike[0]), (1, unlike[1]), (1, unlike[1]), (2, unlike[2]), (3, unlike[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op.keep_one(docs).collect())) == sorted(
        [(1, unlike[0]), (1, unlike[1]), (2, unlike[2])])
    texts = [(1, unlike[0]), (2, f"{unlike[0]} {unlike[1]}"), (2, unlike[2])]
    cut = passages.cut_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert (2, unlike[2]) in map(tuple, cut) and (1, unlike[0]) in map(tuple, cut)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    docs = odd_documents(spark, empty)
    kept = op.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    texts = {} if empty else {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    want = set(least_ids(texts).values()) | ({None} if texts else set())
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)


def test_components_in_few_rounds(spark, monkeypatch):
    """A long chain beside a star: few tables are written, also where links lie in many parts."""
    from themeloom.llm import components as linked
    from themeloom.session import recorded

    draw = random.Random(6)
    ids = draw.sample(range(10 ** 6), 3000)
    edges = [*zip(ids[:2000], ids[1:2000]), *((i, ids[2000]) for i in ids[2000:])]
    draw.shuffle(edges)
    want = {i: min(part) for part in (ids[:2000], ids[2000:]) for i in part}
    table = spark.createDataFrame(edges, "src long, dst long")
    for local, most in ((1 << 14, 2), (700, 13)):
        monkeypatch.setattr(linked, "LOCAL", local, raising=False)
        with recorded() as tables:
            roots = linked.components(table).collect()
        assert len(roots) == len(want) and dict(roots) == want
        assert len(tables) <= most

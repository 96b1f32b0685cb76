from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tests.llm.brute import odd_documents
from themeloom.llm import decontaminate as op
from themeloom.llm.tables import QUERIES


def terms(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(
        {c: c + 32 for c in range(65, 91)}))


def bag(found):
    k = min(5, len(found))
    return Counter(tuple(found[i:i + k]) for i in range(len(found) - k + 1))


def best(text, item):
    """Greatest weighted similarity of an item and a window of its size."""
    a, b = terms(text), terms(item)
    if not b or len(a) < len(b):
        return 0.0
    own = bag(b)
    return max((own & w).total() / (own | w).total()
               for w in (bag(a[i:i + len(b)]) for i in range(len(a) - len(b) + 1)))


def test_against_all_windows(spark):
    draw = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "aeiou"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 6, 12, 20, 30, 30, 45, 60, 60])]
    docs = []
    for d in range(60):
        words = text(draw.randrange(5, 90)).split()
        for _ in range(draw.randrange(3)):
            piece = draw.choice(items)[1].split()
            for _ in range(draw.randrange(3)):  # near copies
                piece[draw.choice([0, -1, draw.randrange(len(piece))])] = draw.choice(vocabulary)
            at = draw.randrange(len(words))
            words[at:at] = piece
        docs.append((d, ", ".join(words).title()))
    got = op.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i): s for d, t in docs for i, x in items if (s := best(t, x)) >= 0.8}
    assert len(want) > 20 and any(0.8 <= s < 1 for s in want.values())
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want


def test_texts_shorter_than_an_item(spark):
    draw = random.Random(6)
    items = [(i, [f"w{draw.randrange(10 ** 6)}" for _ in range(n)])
             for i, n in enumerate([1, 3, 4, 5, 6, 16, 17, 25, 40, 59])]
    docs = []
    for _, own in items:
        for a in range(min(len(own), 9)):
            docs += [own[a:], own[:len(own) - a], own[a // 2:len(own) - a + a // 2]]
            changed = own[a:]
            changed[draw.randrange(len(changed))] = "changed"
            docs.append(changed)

    def whole(text, item):
        """As ``best``, with a text shorter than the item as one window."""
        a, b = terms(text), terms(item)
        if len(a) >= len(b):
            return best(text, item)
        k = min(5, len(b))
        own, mine = bag(b), Counter(tuple(a[i:i + k]) for i in range(len(a) - k + 1))
        return (own & mine).total() / (own | mine).total()

    docs = [(d, " ".join(own)) for d, own in enumerate(docs)]
    items = [(i, " ".join(own)) for i, own in items]
    docs_, items_ = (spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i): s for d, t in docs for i, x in items if (s := whole(t, x)) >= 0.8}
    short = {(d, i) for d, i in want if len(terms(docs[d][1])) < len(terms(items[i][1]))}
    assert len(short) > 20
    got = op.contaminated(docs_, items_).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert all(r.n_words == len(terms(docs[r.doc_id][1])) for r in got
               if (r.doc_id, r.item_id) in short)
    gone = {d for d, _ in want}
    assert {r.doc_id for r in op.keep_clean(docs_, items_).collect()} == {
        d for d, _ in docs} - gone


def test_query_finds_whole_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.similarity
           for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    joined = {r.doc_id: f" {' '.join(terms(r.text))} " for r in docs}
    want = {(d, r.item_id) for r in items for d, t in joined.items()
            if f" {' '.join(terms(r.text))} " in t}
    assert {k for k, s in got.items() if s == 1} == want and want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    passage = next(r.text for r in docs.collect() if r.doc_id == 8)
    rows = [(1, None, "z"), (2, "", "z"), (3, "!!", "z"), (4, passage, "z"), (4, passage, "z"),
            (5, "a", None), (None, "no id here", "z")]
    items = spark.createDataFrame(rows, "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in op.contaminated(docs, items).collect()}
    assert found == {(7, 4), (8, 4), (3, 5), (4, 5)}
    kept = op.keep_clean(docs, items)
    assert kept.columns == docs.columns
    gone = docs.count() - kept.count()
    assert gone == 6  # with the copies of row 7
    assert op.contaminated(docs, items.filter("false")).count() == 0
    assert op.contaminated(odd_documents(spark, empty=True), items).count() == 0

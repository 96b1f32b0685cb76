from __future__ import annotations

import json

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.brute import odd_documents
from themeloom.llm import token_count as op
from themeloom.llm.tables import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = op.Counter(json.load(open(PATH, encoding="utf-8")), remembered=50)


def wanted(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_query_against_the_library(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op4_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == wanted(texts[r.doc_id])
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
        assert r.over_limit == (r.n_tokens > 2048)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=40), st.text(alphabet="aàA's'tr eélL12 .!ΣİNFĆ\n\t  ", max_size=40),
    st.sampled_from(["<|endoftext|>", "x<|startoftext|>y", "'ll've'RE 's", "a" * 700, "''s 's"])),
    max_size=6))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert COUNTER.counts(texts).tolist() == [wanted(t) for t in texts]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.token_counts(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    assert all(r.n_tokens == wanted(texts[r.doc_id]) for r in rows)
    assert op.token_counts(odd_documents(spark, empty=True), PATH).count() == 0

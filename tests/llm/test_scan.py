from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import WORD
from themeloom.llm import scan
from themeloom.llm.tables import slices

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n中!.\x0b", max_size=30)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(rows):
    found = scan.words(pa.array(rows, pa.string()))
    got = [[found.data[a:b].tobytes() for a, b in zip(found.start[i:j], found.end[i:j],
                                                      strict=True)]
           for i, j in zip(found.first, found.first[1:], strict=False)]
    assert got == [[w.lower() for w in WORD.findall((t or "").encode())] for t in rows]


def test_terms_leave_signs_out():
    found = scan.words(pa.array(["Don't, stop!", None, "é-b"]), scan.BETWEEN_TERMS)
    got = [found.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]
    assert got == re.findall(r"[a-zé]+", "don t stop é b")


def test_hashes_depend_on_the_word_alone():
    a = scan.words(pa.array(["one two one", "two"]))
    b = scan.words(pa.array(["x", "two", "one"]))
    ha, hb = scan.word_hashes(a), scan.word_hashes(b)
    assert ha[0] == ha[2] == hb[2] and ha[1] == ha[3] == hb[1] and len(set(ha)) == 2
    own, inside = scan.runs(ha, a.first, 2)
    assert inside.tolist() == [True, True, False, False]
    assert own[0] != own[1]


def test_slices_cover_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 50, "c"]})
    parts = list(slices(batch, "text", 12, 2))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert max(p.num_rows for p in parts) <= 2
    assert not list(slices(batch.slice(0, 0), "text"))
    assert np.array_equal(scan.text_bytes(batch.column("text"))[1], [0, 10, 10, 10, 60, 61])

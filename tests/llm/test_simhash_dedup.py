from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute
from themeloom.llm import simhash_dedup as op
from themeloom.llm.tables import QUERIES

SCHEMA = "doc_id long, text string, fp string, component_id int"


def test_query_against_brute_force(spark, sf):
    rows = QUERIES["op2_simhash_dedup"](spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    prints = [brute.fingerprint(texts[r.doc_id]) for r in rows]
    assert [int(r.fingerprint, 16) for r in rows] == prints
    assert [r.component_id for r in rows] == brute.classes(prints, [r.doc_id for r in rows])


@pytest.mark.parametrize("task_rows", [4, 30, 50_000])
def test_links_at_any_task_size(spark, task_rows):
    draw = random.Random(task_rows)
    values = set()
    for _ in range(25):
        seed = draw.getrandbits(64)
        values |= {seed ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
                   for _ in range(draw.randrange(1, 12))}
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    edges = op.links(spark.createDataFrame([(v,) for v in signed], "fp long"),
                     task_rows=task_rows)
    from themeloom.llm.components import components
    roots = dict(components(edges).collect())
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(roots.get(s, s), []).append(v)
    wanted = {}
    for v, c in zip(values, brute.classes(values, values), strict=True):
        wanted.setdefault(c, []).append(v)
    assert sorted(map(sorted, groups.values())) == sorted(wanted.values())


def test_odd_rows(spark):
    long = "one two three four " * 5000
    rows = [(1, None, "x", 7), (2, "", "x", 7), (3, " \t\n", None, None), (4, "a", "x", 1),
            (5, "A", "x", 1), (5, "A", "x", 1), (6, long, "x", 1), (None, long, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted((r.doc_id or 0, r.fp, r.component_id) for r in op.near_duplicates(docs).collect())
    assert [r[2] for r in out] == [6, 1, 1, 1, 4, 4, 4, 6]
    assert [r[1] for r in out[1:4]] == [0, 0, 0]
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6]
    empty = spark.createDataFrame([], SCHEMA)
    assert op.near_duplicates(empty).count() == 0 and op.keep_one(empty).count() == 0

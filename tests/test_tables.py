"""What queries write on their way."""

from __future__ import annotations

import os

from themeloom.catalog import QUERIES, sets
from themeloom.session import recorded

SF = "/root/testdata/sf0.01"


def test_written_reports_train_once(spark, sf):
    with recorded() as once:
        QUERIES["class_report"](spark, sf).collect()
    with recorded() as tables:
        QUERIES["written_reports"](spark, sf).collect()
    assert len(tables) == len(once)


def test_leakage_counts_write_no_texts(spark, sf):
    with recorded() as tables:
        QUERIES["leakage_counts"](spark, sf).collect()
    assert tables and all("text" not in spark.read.parquet(t).columns for t in tables)


def test_near_copy_rate_keeps_only_its_splits(spark, sf):
    with recorded() as tables:
        QUERIES["near_copy_rate"](spark, sf).collect()
    left = [t for t in tables if os.path.exists(t)]
    assert left and all("category" not in spark.read.parquet(t).columns for t in left)


def test_near_copy_rate_splits_without_texts(spark, sf, monkeypatch):
    columns = []

    def spy(records, *args, split=sets.dataset.split_records, **named):
        columns.extend(records.columns)
        return split(records, *args, **named)

    monkeypatch.setattr(sets.dataset, "split_records", spy)
    QUERIES["near_copy_rate"](spark, sf)
    assert "key" in columns and "text" not in columns


def test_card_files_that_are_not_cut_hold_many_cards(spark, monkeypatch):
    written = []

    def spy(rows, folder, write=sets._one_per_file):
        written.append(rows)
        return write(rows, folder)

    monkeypatch.setattr(sets, "_one_per_file", spy)
    QUERIES["card_file_problems"](spark, SF).collect()
    whole = written[0].filter("value like '%]'")
    assert whole.count() <= 80  # one for each category


def test_shuffle_files_of_finished_steps_are_let_go(spark, monkeypatch):
    import time

    from themeloom import session
    from themeloom.operators import similarity

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()

    def files():
        return manager.diskBlockManager().getAllFiles().size()

    def settled(most):
        until = time.time() + 30
        while files() > most and time.time() < until:
            time.sleep(0.2)
        return files() <= most

    session.sweep(spark)
    time.sleep(2)
    before = files()
    session.materialize(spark.range(1000).repartition(7))
    assert files() > before
    session.sweep(spark)
    assert settled(before)
    asked = []
    monkeypatch.setattr(similarity, "sweep", lambda s: asked.append(s))
    docs = spark.createDataFrame([(1, "one text of some words"), (2, "another one")], "id long, text string")
    assert similarity.near_copies(docs, docs).count() == 2 and len(asked) == 2

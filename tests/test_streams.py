from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from themeloom.operators import replay
from themeloom.streaming.cooldown import stream_cooldown
from themeloom.streaming.running import running_themes
from themeloom.streaming.scoring import store_batches

SCORED = ("conv_id long, turn long, reset boolean, ts timestamp, general_scores map<string,double>, "
          "joint_subtopic_scores map<string,map<string,double>>")


def append(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def run_once(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_cooldown_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    log = sorted((rng.randrange(0, 4_000), i, rng.choice("aaab"), rng.random() < .3)
                 for i in range(300))
    log += [(t + 1, 1000 + i, "c", True) for i, t in enumerate(range(4_000, 4_300, 30))]
    schema = "ts timestamp, id long, k string, failed boolean"
    rows = spark.createDataFrame(log, "t long, id long, k string, failed boolean").select(
        F.timestamp_seconds("t").alias("ts"), "id", "k", "failed").collect()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, len(rows), 100):
        part = rows[i:i + 100]
        rng.shuffle(part)                                   # out of order inside the delay
        append(spark.createDataFrame(part, schema), source)
    append(spark.sql("SELECT timestamp'1970-01-02' AS ts, -1L AS id, 'end' AS k, false AS failed"),
           source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    cold = stream_cooldown(stream, "k", "ts", "id", "failed", 120, "30 minutes")
    run_once(store_batches(cold, out, str(tmp_path / "state")))
    batch = replay.apply_cooldown(spark.createDataFrame(rows, schema), "k", "ts", "id",
                                  F.col("failed"), 120)
    got = sorted(map(tuple, spark.read.parquet(out).select("id", "k", "suppressed").collect()))
    assert got == sorted(map(tuple, batch.select("id", "k", "suppressed").collect()))
    assert any(s for *_, s in got) and not all(s for *_, s in got)


def recurrence(batches, decay, idle):
    """One message after the other: (session, index, late, scores) by (conv, turn)."""
    state, out = {}, {}
    for batch in batches:
        for conv, turn, reset, ts, scores, _ in sorted(batch, key=lambda r: r[:2]):
            session, index, last, seen, sums = state.get(conv, (0, 0, -1, None, {}))
            if turn <= last:
                out[conv, turn] = (None, None, True, None)
                continue
            if reset or (idle is not None and seen is not None and ts - seen > idle):
                session, index, sums = session + 1, 0, {}
            if scores is not None and not reset:
                index += 1
                sums = {k: sums.get(k, 0) * decay + scores.get(k, 0) for k in "AB"}
                out[conv, turn] = (session, index, False, sums)
            state[conv] = (session, index, turn, ts, sums)
    return out


@pytest.mark.parametrize("idle", [None, 50])
def test_running_themes_equal_the_recurrence(spark, tmp_path, monkeypatch, idle):
    monkeypatch.setattr("themeloom.streaming.running.RUN_TURNS", 4)
    monkeypatch.setattr("themeloom.streaming.running.SNAPSHOT_EVERY", 2)
    rng = random.Random(8)
    batches = [[], [], [], []]
    clock = dict.fromkeys(range(6), 0)
    for turn in range(40):
        for conv in range(6):
            clock[conv] += rng.choice([5, 20, 80])
            held = rng.random() < .1
            scores = None if rng.random() < .2 else {"A": rng.random(), "B": rng.random()}
            batches[3 if held else min(turn // 10 + (conv == 5), 3)].append(
                (conv, turn, rng.random() < .1, clock[conv], scores, {}))
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        rows = spark.createDataFrame(
            batch, SCORED.replace("ts timestamp", "ts long")).withColumn(
            "ts", F.timestamp_seconds("ts"))
        append(rows, source)
        stream = spark.readStream.schema(rows.schema).parquet(source)     # restarts each time
        run_once(running_themes(stream, folder, str(tmp_path / "state"), ["A", "B"], decay=.6,
                                ts="ts", idle_seconds=idle))
    got = {}
    for r in spark.read.parquet(f"{folder}/turns").collect():
        assert (r.conv_id, r.turn) not in got
        got[r.conv_id, r.turn] = (None, None, True, None) if r.late else (
            r.session_no, r.message_index, False,
            {s.name: pytest.approx(s.score, abs=1e-12) for s in r.scores})
    want = recurrence(batches, .6, idle)
    assert any(w[2] for w in want.values()) and got == want


def test_cooldown_query_reads_deliveries_of_many_files(spark, sf, tmp_path):
    """Each file of a delivery spans all of its days; no row may be left out as late."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    queries = entry.queries()
    want = queries["cooldown_suppress"](spark, sf).collect()
    got = queries["stream_cooldown_suppress"](spark, str(tmp_path)).collect()
    assert len(got) == events.count()
    assert {tuple(r.asDict().items()) for r in got} == {tuple(r.asDict().items()) for r in want}

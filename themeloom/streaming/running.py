"""Conversations as micro-batches: running themes with state in written tables.

What a micro-batch does to a conversation's scores is one affine map: a scale (the decay to the
power of its messages) and what its messages add.  The sums inside a batch come from the batch
operators, the state before it is scaled and added, and the last row of each conversation is the state
after it.  All of it is joins and aggregations: no loop over messages, and no conversation has to fit
a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from themeloom import constants as K
from themeloom.operators.conversation import RUN_TURNS, decayed_sums, pack_scores
from themeloom.operators.joins import running_total
from themeloom.operators.scans import over_earlier
from themeloom.session import materialize

# Batches between two tables that hold the state of all conversations.
SNAPSHOT_EVERY = 16
_STATE = "conv long, session long, idx long, last long, seen long, sums array<double>"


def read_state(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """State of each conversation before a batch: the last written one, none before the first."""
    if not batch_id:
        return spark.createDataFrame([], _STATE)
    first = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    paths = [f"{folder}/state/batch_id={b}" for b in range(first, batch_id)]
    rows = spark.read.option("basePath", f"{folder}/state").schema(
        f"{_STATE}, batch_id long").parquet(*paths)
    fields = ["session", "idx", "last", "seen", "sums"]
    return rows.groupBy("conv").agg(F.max_by(F.struct(*fields), "batch_id").alias("_s")).select(
        "conv", "_s.*")


def _openings(rows: DataFrame, idle_us: int | None) -> DataFrame:
    """``rows`` with ``opens``: a reset, or more than the idle time after the message before."""
    if idle_us is None:
        return rows.withColumn("opens", F.col("reset").cast("long"))
    runs = rows.groupBy("conv", "_run").agg(F.max(F.struct("turn", "ts")).alias("_end"))
    ends = over_earlier(runs, ["conv"], "_run", "_end", "max", "_before")
    inside = F.lag("ts").over(Window.partitionBy("conv", "_run").orderBy("turn"))
    timed = rows.withColumn("_prev", inside).join(
        ends.select("conv", "_run", "_before"), ["conv", "_run"], "left")
    gap = F.col("ts") - F.coalesce("_prev", "_before.ts", "seen")
    return timed.withColumn("opens", (F.col("reset") | F.coalesce(gap > idle_us, F.lit(False)))
                            .cast("long")).drop("_prev", "_before")


def advance(batch: DataFrame, state: DataFrame, general: Sequence[str],
            subtopics: Sequence[tuple[str, str]], decay: float = K.DECAY,
            idle_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, state) after a batch of (conv, turn, reset, ts, general_scores,
    joint_subtopic_scores); messages without scores have no content."""
    width = len(general) + len(subtopics)
    names = [f"_v{i}" for i in range(width)]
    zero = F.lit(0.0)
    general_p = [F.try_element_at("general_scores", F.lit(g)) for g in general]
    joint_p = [F.try_element_at(F.try_element_at("joint_subtopic_scores", F.lit(g)), F.lit(s))
               for g, s in subtopics]
    rows = batch.select(
        "conv", "turn", "reset", "ts", F.col("general_scores").isNotNull().alias("content"),
        *[F.coalesce(p, zero).alias(n) for p, n in zip([*general_p, *joint_p], names, strict=True)])
    before = state.select("conv", "session", "idx", "last", "seen")
    rows = rows.join(before, "conv", "left").withColumn("_run", F.floor(F.col("turn") / RUN_TURNS))
    rows = materialize(rows.fillna({"session": 0, "idx": 0, "last": -1}))
    timely = _openings(rows.filter("turn > last"), idle_us)
    cut = materialize(running_total(timely, ["conv"], "_run", [F.col("turn")], F.col("opens"),
                                    "_opened").withColumn("session_no", F.col("session") + F.col(
                                        "_opened")))
    said = running_total(cut.filter("content and not reset"), ["conv", "session_no"], "_run",
                         [F.col("turn")], F.lit(1).cast("long"), "_k")
    kept = materialize(said.select("conv", "turn", "session", "session_no", "idx", "_k", *names))
    summed = decayed_sums(kept, ["conv", "session_no"], "_k", names, decay)
    old = state.select("conv", F.col("session").alias("session_no"), F.col("sums").alias("_old"))
    summed = summed.join(old, ["conv", "session_no"], "left")
    scale = F.pow(F.lit(float(decay)), F.col("_k").cast("double"))
    summed = materialize(summed.select(
        "conv", "turn", "session_no",
        (F.col("_k") + F.when(F.col("session_no") == F.col("session"), F.col("idx")).otherwise(0))
        .alias("message_index"),
        *[(F.col(n) + F.coalesce(F.get("_old", F.lit(i)), zero) * scale).alias(n)
          for i, n in enumerate(names)]))
    turns = summed.select(
        "conv", "turn", "session_no", "message_index", F.lit(False).alias("late"),
        *pack_scores(general, subtopics, names[:len(general)], names[len(general):]))
    late = rows.filter("turn <= last").select(
        "conv", "turn", F.col("session").alias("session_no"), F.lit(True).alias("late"))
    ends = cut.groupBy("conv").agg(F.max("session_no").alias("session"), F.max("turn").alias("last"),
                                   F.max("ts").alias("seen"))
    last = summed.groupBy("conv").agg(F.max_by(
        F.struct(F.col("session_no").alias("session"), F.col("message_index").alias("idx"),
                 F.array(*names).alias("sums")), F.struct("session_no", "message_index"))
        .alias("_n")).select("conv", "_n.*")
    after = ends.join(last, ["conv", "session"], "left").join(
        state.select("conv", "session", F.col("idx").alias("_idx"), F.col("sums").alias("_sums")),
        ["conv", "session"], "left")
    # No message in the conversation's last session: it is the session before, or a new one.
    after = after.select("conv", "session", F.coalesce("idx", "_idx", F.lit(0)).alias("idx"), "last",
                         "seen", F.coalesce("sums", "_sums", F.array().cast("array<double>"))
                         .alias("sums"))
    return turns.unionByName(late, allowMissingColumns=True), after


def running_themes(stream: DataFrame, folder: str, checkpoint: str, general: Sequence[str],
                   subtopics: Sequence[tuple[str, str]] = (), decay: float = K.DECAY,
                   conversation: str = "conv_id", turn: str = "turn", reset: str = "reset",
                   ts: str | None = None, idle_seconds: float | None = None,
                   score: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataStreamWriter:
    """Write the running scores of each message to ``folder``/turns and the state to its side.

    ``score`` turns a micro-batch of raw messages into rows with general_scores and
    joint_subtopic_scores.  The result is that of segmenting plus decayed sums, whatever the batches;
    turns at or before the last one seen come out as ``late``, without scores.  With
    ``idle_seconds`` (and ``ts``) a message that comes later than that after the one before opens
    a new session.  Every batch overwrites its own folders and reads the state before it, so
    a replayed batch neither loses nor repeats rows.
    """
    idle = None if idle_seconds is None else int(idle_seconds * 1_000_000)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamp: Column = F.unix_micros(ts) if ts else F.lit(None).cast("long")
        rows = score(batch).select(
            F.col(conversation).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
            F.col(reset).alias("reset"), stamp.alias("ts"), "general_scores",
            "joint_subtopic_scores")
        state = read_state(spark, folder, batch_id)
        turns, after = advance(rows, state, general, subtopics, decay, idle)
        if batch_id % SNAPSHOT_EVERY == 0:
            after = after.unionByName(state.join(after.select("conv"), "conv", "left_anti"))
        after.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")
        turns.withColumnsRenamed({"conv": conversation, "turn": turn}).write.mode(
            "overwrite").parquet(f"{folder}/turns/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

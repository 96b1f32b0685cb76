"""Conversations as a stream: running topic state per session."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from themeloom import constants as K
from themeloom.operators.conversation import pack_scores


def stream_scores(scored: DataFrame, general: Sequence[str],
                  subtopics: Sequence[tuple[str, str]] = (), decay: float = K.DECAY,
                  conversation: str = "conv_id", turn: str = "turn", reset: str = "reset",
                  scores_col: str = "general_scores", joint_col: str = "joint_subtopic_scores",
                  idle_ms: int | None = None) -> DataFrame:
    """Streaming twin of segmenting plus decayed sums; the same columns as the batch result.

    State per conversation is one array of sums, a session number, a message index and the last
    turn seen: its size depends on the labels, not on the messages.  A reset clears the sums and
    opens the next session; rows without scores (no content) are skipped.  Turns at or before the
    last one seen can't enter sums that have gone on: they come out with ``late`` set and without
    scores, to be stored beside the others.  With ``idle_ms`` the sums of a conversation that was
    idle so long are let go; its session number stays, and its next message opens a new session.
    Leave it None when a finite backlog is replayed: the clock-driven expiry would keep an
    ``availableNow`` run going for ever.
    """
    zero = F.lit(0.0)
    wide = scored.select(
        F.col(conversation).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.col(reset).alias("reset"), F.col(scores_col).isNotNull().alias("content"),
        F.array(
            *[F.coalesce(F.try_element_at(F.col(scores_col), F.lit(g)), zero) for g in general],
            *[F.coalesce(F.try_element_at(F.try_element_at(F.col(joint_col), F.lit(g)),
                                          F.lit(s)), zero) for g, s in subtopics]).alias("p"))
    width = len(general) + len(subtopics)

    def advance(key, frames, state: GroupState):
        session, index, last, sums = state.get if state.exists else (0, 0, -1, [0.0] * width)
        if state.hasTimedOut:
            state.update((session + 1, 0, last, []))
            return
        sums = [float(s) for s in sums] or [0.0] * width
        out = []
        batch = pd.concat(list(frames)).sort_values("turn")
        for row in batch.itertuples(index=False):
            if row.turn <= last:
                out.append((int(key[0]), int(row.turn), session, None, True, None))
                continue
            last = int(row.turn)
            if row.reset:
                session, index, sums = session + 1, 0, [0.0] * width
            elif row.content:
                index += 1
                sums = [s * decay + float(x) for s, x in zip(sums, row.p, strict=True)]
                out.append((int(key[0]), last, session, index, False, list(sums)))
        state.update((session, index, last, sums))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        frame = pd.DataFrame(out, columns=["conv", "turn", "session_no", "message_index", "late",
                                           "sums"])
        yield frame.astype({"message_index": "Int64"})

    result = wide.groupBy("conv").applyInPandasWithState(
        advance,
        "conv long, turn long, session_no long, message_index long, late boolean, "
        "sums array<double>",
        "session long, idx long, last long, sums array<double>",
        "append", GroupStateTimeout.NoTimeout if idle_ms is None
        else GroupStateTimeout.ProcessingTimeTimeout)
    spread = result.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), "session_no",
        "message_index", "late",
        *[F.col("sums")[i].alias(f"_x{i}") for i in range(width)])
    names = [f"_x{i}" for i in range(width)]
    return spread.select(
        conversation, turn, "session_no", "message_index", "late",
        *pack_scores(general, subtopics, names[:len(general)], names[len(general):]))

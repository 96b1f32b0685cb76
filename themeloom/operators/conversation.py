"""The running topic of a conversation.

Every operator here is a running computation per session.  Sessions are cut into runs of bounded
length whose results combine exactly, so a session holding most of the messages is still spread
over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom import constants as K
from themeloom.functions import decisions as D
from themeloom.functions import phrases, text
from themeloom.functions.binding import let
from themeloom.operators.joins import running_total
from themeloom.session import materialize

RUN_TURNS = 4_096


def segment_sessions(messages: DataFrame, reset: Column, content: Column,
                     conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Cut conversations at reset messages and number the messages that carry content.

    Adds ``session_no`` (resets so far) and ``message_index`` (from 1 in each session); reset
    messages and messages without content are left out.  ``turn`` is unique per conversation.

    The flags cost a normalisation of every text and are read by several running sums, so the
    marked messages are written once.
    """
    marked = materialize(messages.select(
        "*", reset.cast("long").alias("_reset"), (content & ~reset).alias("_content"),
        F.floor(F.col(turn) / RUN_TURNS).alias("_run")))
    sessions = running_total(marked, [conversation], "_run", [F.col(turn)], F.col("_reset"),
                             "session_no")
    kept = sessions.filter("_content")
    numbered = running_total(kept, [conversation, "session_no"], "_run", [F.col(turn)],
                             F.lit(1).cast("long"), "message_index")
    return numbered.drop("_reset", "_content", "_run")


def run_length(decay: float) -> int:
    """Turns per run such that decay^-length stays far inside double range."""
    return max(1, min(1_000, int(250 / -math.log10(decay)))) if decay > 0 else 1_000


def decayed_sums(df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str],
                 decay: float = K.DECAY) -> DataFrame:
    """Replace each value column by s[n] = s[n-1] * decay + value[n] along ``index`` (1, 2, ...).

    Inside a run the recurrence is a scaled running sum.  Full runs hand their end value on to
    the next one; only sessions longer than a run have any, so that table is normally empty.
    """
    if not 0.0 <= decay < 1.0:
        raise ValueError("decay must lie in [0, 1)")
    if decay == 0.0:
        return df
    length = run_length(decay)
    d = F.lit(float(decay))
    placed = df.withColumn("_run", F.floor((F.col(index) - 1) / length)).withColumn(
        "_pos", ((F.col(index) - 1) % length).cast("double"))
    inner = (Window.partitionBy(*keys, "_run").orderBy(index)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = placed.select(
        *[c for c in placed.columns if c not in values],
        *[(F.sum(F.col(v) * F.pow(d, -F.col("_pos"))).over(inner) * F.pow(d, F.col("_pos")))
          .alias(v) for v in values])
    ends = placed.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(v) * F.pow(d, F.lit(length - 1.0) - F.col("_pos"))).alias(v)
          for v in values]).filter(F.col("_n") == length)
    # Runs further back weigh less than decay^length each; this many cover 1e-36.
    reach = max(1, math.ceil(36 * math.log(10) / (length * -math.log(decay))))
    back = Window.partitionBy(*keys).orderBy("_run").rowsBetween(1 - reach, Window.currentRow)
    factor = F.lit(float(decay) ** length)
    carried = ends.select(
        *keys, (F.col("_run") + 1).alias("_run"),
        *[F.aggregate(F.collect_list(v).over(back), F.lit(0.0), lambda a, x: a * factor + x)
          .alias(f"_c_{v}") for v in values])
    joined = local.join(carried, [*keys, "_run"], "left")
    return joined.select(
        *[c for c in df.columns if c not in values],
        *[(F.col(v) + F.coalesce(F.col(f"_c_{v}"), F.lit(0.0)) * F.pow(d, F.col("_pos") + 1))
          .alias(v) for v in values])


def conversation_scores(scored: DataFrame, keys: Sequence[str], index: str, general: Sequence[str],
                        subtopics: Sequence[tuple[str, str]] = (), decay: float = K.DECAY,
                        scores_col: str = "general_scores",
                        joint_col: str = "joint_subtopic_scores") -> DataFrame:
    """Decayed topic and subtopic scores after each message.

    ``scores_col`` maps a topic to its probability, ``joint_col`` a topic to a map of subtopic
    probabilities.  Topics are the fixed labels, so each one is a column and a message stays one
    row.  The result has ``scores`` (array of name, score) and ``sub_scores`` (general, subtopic,
    p).
    """
    zero = F.lit(0.0)
    g_cols = [f"_g{i}" for i in range(len(general))]
    s_cols = [f"_s{i}" for i in range(len(subtopics))]
    rest = [c for c in scored.columns if c not in (scores_col, joint_col)]
    # Read by the running sums and by the ends of the runs: scoring must not happen twice.
    wide = materialize(scored.select(
        *rest,
        *[F.coalesce(F.try_element_at(F.col(scores_col), F.lit(g)), zero).alias(c)
          for g, c in zip(general, g_cols, strict=True)],
        *[F.coalesce(F.try_element_at(F.try_element_at(F.col(joint_col), F.lit(g)), F.lit(s)),
                     zero).alias(c) for (g, s), c in zip(subtopics, s_cols, strict=True)]))
    summed = decayed_sums(wide, keys, index, [*g_cols, *s_cols], decay)
    return summed.select(*rest, *pack_scores(general, subtopics, g_cols, s_cols))


def pack_scores(general: Sequence[str], subtopics: Sequence[tuple[str, str]],
                g_cols: Sequence[str], s_cols: Sequence[str]) -> list[Column]:
    scores = F.array(*[F.struct(F.lit(g).alias("name"), F.col(c).alias("score"))
                       for g, c in zip(general, g_cols, strict=True)])
    if subtopics:
        subs = F.array(*[F.struct(F.lit(g).alias("general"), F.lit(s).alias("subtopic"),
                                  F.col(c).alias("p"))
                         for (g, s), c in zip(subtopics, s_cols, strict=True)])
    else:
        subs = F.array().cast("array<struct<general:string,subtopic:string,p:double>>")
    return [scores.alias("scores"), subs.alias("sub_scores")]


def themes(df: DataFrame, other: str = K.OTHER_LABEL, min_share: float = K.TOPIC_MIN_SHARE,
           limit: int = K.MAX_THEME_TOPICS, forms: phrases.Forms = K.TOPIC_FORMS,
           heads: Mapping[str, str] = K.MEDIUM_HEADS,
           uncertain_label: str = K.UNCERTAIN_LABEL) -> DataFrame:
    """Theme of each row from its ``scores`` and ``sub_scores``; per-row expressions only.

    Adds topics (name, score as share), phrase, focus_subtopic, uncertain and theme_label.
    """
    def total(items: Column, name: str) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda a, s: a + s[name])

    empty = F.array().cast("array<struct<name:string,score:double>>")
    topical = F.filter("scores", lambda s: s["name"] != other)
    outside = total(F.filter("scores", lambda s: s["name"] == other), "score")
    step = df.withColumn("_topical", topical).withColumn("_other", outside)
    step = step.withColumn("_total", total(F.col("_topical"), "score"))
    step = step.withColumn("uncertain", (F.col("_total") <= 0) | (F.col("_other") >
                                                                  F.col("_total")))
    shares = D.ranked(let(F.col("_total"), lambda all_: F.transform("_topical", lambda s: F.struct(
        s["name"].alias("name"), (s["score"] / all_).alias("score")))))
    step = step.withColumn("_shares", F.when(~F.col("uncertain"), shares).otherwise(empty))
    strong = F.slice(F.filter("_shares", lambda s: s["score"] >= min_share), 1, limit)
    step = step.withColumn("topics", F.when(F.size(strong) > 0, strong).otherwise(
        F.slice("_shares", 1, 1)))
    mine = let(F.col("topics")[0]["name"], lambda topic: F.transform(
        F.filter("sub_scores", lambda s: s["general"] == topic),
        lambda s: F.struct(s["subtopic"].alias("name"), s["p"].alias("score"))))
    step = step.withColumn("_subs", F.when(F.size("topics") == 1, mine).otherwise(empty))
    best = F.try_element_at(D.ranked(F.col("_subs")), F.lit(1))
    sub_total = total(F.col("_subs"), "score")
    step = step.withColumn("focus_subtopic", F.when(
        (sub_total > 0) & (best["score"] >= sub_total * F.lit(K.SUBTOPIC_FOCUS_SHARE)),
        best["name"]))
    names = F.transform("topics", lambda t: t["name"])
    phrase = F.when(F.col("focus_subtopic").isNotNull(),
                    text.turkish_lower(F.col("focus_subtopic"))).otherwise(
        phrases.compose_phrase(names, forms, heads))
    return step.withColumn("phrase", phrase).withColumn(
        "theme_label", phrases.theme_label(names, F.col("focus_subtopic"), F.col("uncertain"),
                                           uncertain_label)).drop(
        "_topical", "_other", "_total", "_shares", "_subs")


def search_queries(themed: DataFrame, keywords: str = "keywords") -> DataFrame:
    """Add ``query`` from the theme and an array of keywords; null while the theme is uncertain."""
    core = F.coalesce(F.col("focus_subtopic"), F.col("phrase"))
    active = ~F.col("uncertain") & (F.size("topics") > 0)
    return themed.withColumn("query", phrases.build_query(core, active, F.col(keywords)))

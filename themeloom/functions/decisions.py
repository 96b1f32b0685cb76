"""Scores to decisions: softmax, marginals, thresholds, subtopic and topic lists.

Classes are joint labels ``"general > subtopic"`` (or just ``"general"``); a document's
probabilities are one array in class order.  Every reduction over classes is written out as an
expression, so scoring a document never leaves its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.functions.binding import let


def joint_label(general: Column, subtopic: Column) -> Column:
    """``general > subtopic``, or the general label alone without a subtopic."""
    missing = subtopic.isNull() | (subtopic == "")
    return F.when(missing, general).otherwise(F.concat(general, F.lit(K.JOINT_SEPARATOR), subtopic))


def split_joint(label: Column) -> Column:
    """Struct (general, subtopic); subtopic is null where there is none."""
    parts = F.split(label, K.JOINT_SEPARATOR, 2)
    return F.struct(parts[0].alias("general"), F.try_element_at(parts, F.lit(2)).alias("subtopic"))


def split_class(label: str) -> tuple[str, str | None]:
    general, found, subtopic = label.partition(K.JOINT_SEPARATOR)
    return general, subtopic if found else None


def softmax(scores: Column, temperature: float | Column = 1.0) -> Column:
    """Stable softmax of an array, scores divided by the temperature first."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature

    def powers(z: Column, peak: Column) -> Column:
        return F.transform(z, lambda x: F.exp((x - peak) / t))

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                   lambda total: F.transform(e, lambda x: x / total))

    return let(scores, lambda z: let(F.array_max(z), lambda peak: let(powers(z, peak), shares)))


def _sum(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def general_names(classes: Sequence[str]) -> list[str]:
    """General labels in class order."""
    return list(dict.fromkeys(split_class(c)[0] for c in classes))


def marginals(probabilities: Column, classes: Sequence[str]) -> Column:
    """Array of (name, score): probability of each general label, summed over its classes."""
    names = general_names(classes)
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            _sum([probabilities[i] for i, c in enumerate(classes)
                  if split_class(c)[0] == name]).alias("score"))
        for name in names])


def joint_scores(probabilities: Column, classes: Sequence[str]) -> Column:
    """Array of (general, subtopic, p) for classes that have a subtopic."""
    rows = []
    for i, c in enumerate(classes):
        general, subtopic = split_class(c)
        if subtopic:
            rows.append(F.struct(F.lit(general).alias("general"), F.lit(subtopic).alias("subtopic"),
                                 probabilities[i].alias("p")))
    if not rows:
        return F.array().cast("array<struct<general:string,subtopic:string,p:double>>")
    return F.array(*rows)


def conditionals(joint: Column, general: Column, marginal: Column) -> Column:
    """Array of (name, score): subtopics of one general label as shares of its probability."""
    def shares(name: Column, total: Column) -> Column:
        mine = F.filter(joint, lambda j: j["general"] == name)
        return F.transform(mine, lambda j: F.struct(j["subtopic"].alias("name"),
                                                    (j["p"] / total).alias("score")))
    return F.when(
        marginal > 0, let(F.struct(general.alias("g"), marginal.alias("m")),
                          lambda x: shares(x["g"], x["m"]))
    ).otherwise(F.array().cast("array<struct<name:string,score:double>>"))


def ranked(scored: Column) -> Column:
    """Array of (name, score) by falling score, equal scores by name."""
    def order(a: Column, b: Column) -> Column:
        return (F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.array_sort(scored, order)


def top(scored: Column) -> Column:
    """Best (name, score); the first in array order wins a tie."""
    def first_best(items: Column) -> Column:
        return let(F.array_max(F.transform(items, lambda s: s["score"])),
                   lambda best: F.filter(items, lambda s: s["score"] == best)[0])

    return let(scored, first_best)


def round4(x: Column) -> Column:
    return F.round(x, 4)


def select_subtopics(scored: Column, min_score: float = K.SUBTOPIC_MIN_SCORE,
                     limit: int = K.MAX_SUBTOPICS) -> Column:
    """The best subtopic always, others from ``min_score`` on, at most ``limit``, rounded."""
    kept = F.filter(ranked(scored), lambda s, i: (i == 0) | (s["score"] >= min_score))
    return _rounded(F.slice(kept, 1, limit))


def related_topics(scored: Column, top_name: Column, other: str = K.OTHER_LABEL,
                   min_score: float = K.RELATED_TOPIC_MIN_SCORE) -> Column:
    """Strong topics besides the best one; the out-of-taxonomy label is not a topic."""
    strong = let(top_name, lambda best: F.filter(
        scored, lambda s: (s["name"] != best) & (s["name"] != other)
        & (s["score"] >= min_score)))
    return _rounded(ranked(strong))


def _rounded(scored: Column) -> Column:
    return F.transform(scored, lambda s: F.struct(s["name"].alias("name"),
                                                  round4(s["score"]).alias("score")))


def decide(top_name: Column, confidence: Column, min_confidence: float | Column,
           other: str = K.OTHER_LABEL, uncertain: str = K.UNCERTAIN_LABEL) -> Column:
    """Struct (status, label).

    Out of scope is decided before the threshold, and a confidence equal to it passes.
    """
    limit = F.lit(min_confidence) if isinstance(min_confidence, (int, float)) else min_confidence
    status = (F.when(top_name == other, K.STATUS_OUT_OF_SCOPE)
              .when(confidence < limit, K.STATUS_UNCERTAIN).otherwise(K.STATUS_OK))
    label = (F.when(top_name == other, F.lit(other))
             .when(confidence < limit, F.lit(uncertain)).otherwise(top_name))
    return F.struct(status.alias("status"), label.alias("label"))


def metric_label(status: Column, label: Column, other: str = K.OTHER_LABEL) -> Column:
    """Label used in metrics: anything not accepted counts as the out-of-taxonomy label."""
    return F.when(status == K.STATUS_OK, label).otherwise(F.lit(other))

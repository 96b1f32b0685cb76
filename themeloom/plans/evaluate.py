"""Evaluation of a model on splits it was not trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.operators import linear, metrics
from themeloom.operators.linear import TopicModel
from themeloom.session import materialize


def evaluate(model: TopicModel, records: DataFrame, labels: Sequence[str], id_col: str = "doc_id",
             other: str = K.OTHER_LABEL) -> dict[str, DataFrame]:
    """Reports over the splits test, ood_unseen and external.

    Decisions are written once; every report is an aggregation over them.
    """
    rows = records.filter(F.col("split").isin("test", "ood_unseen", "external")).withColumn(
        "true_subtopic", F.coalesce("subtopic", F.lit("")))
    decided = materialize(linear.decisions(
        model, rows, id_col, "text",
        ["split", "general", "true_subtopic", "category", "source"], other))
    test = decided.filter(F.col("split") == "test")
    accepted = metrics.pair_counts(test, "general", "label")
    guessed = metrics.pair_counts(test, "general", "argmax")
    short = linear.decisions(model, records.filter(F.col("split") == "test"), id_col, "term",
                             ["general"], other)
    ood = decided.filter(F.col("split") == "ood_unseen")
    external = decided.filter(F.col("split") == "external")
    return {
        "thresholded": metrics.summary(accepted, labels),
        "argmax": metrics.summary(guessed, labels),
        "per_class": metrics.class_report(accepted, labels),
        "confusion": metrics.confusion(accepted, labels),
        "subtopic_accuracy": metrics.subtopic_accuracy(test),
        "ece": metrics.calibration_error(test.withColumn(
            "correct", F.col("argmax") == F.col("general"))),
        "status_counts": metrics.status_counts(test),
        "short_inputs": metrics.summary(metrics.pair_counts(short, "general", "argmax"), labels),
        "ood_rejection": metrics.rejection(ood),
        "ood_status_counts": metrics.status_counts(ood),
        "worst_categories": metrics.worst_categories(ood),
        "external_recall": metrics.source_recall(external),
        "external_guesses": external.groupBy("source", "argmax").agg(
            F.count(F.lit(1)).alias("n")),
    }


def check_sentences(predictions: DataFrame, expected: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, expected, actual, confidence, passed); a null expected subtopic is not checked."""
    sub = F.try_element_at(F.col("subtopics"), F.lit(1))["name"]
    joined = expected.join(predictions.withColumn("_sub", sub), id_col)
    passed = F.col("general").eqNullSafe(F.col("expected_general")) & (
        F.col("expected_subtopic").isNull()
        | F.col("_sub").eqNullSafe(F.col("expected_subtopic")))
    return joined.select(
        id_col, F.concat_ws(K.JOINT_SEPARATOR, "expected_general", "expected_subtopic")
        .alias("expected"), F.concat_ws(K.JOINT_SEPARATOR, "general", "_sub").alias("actual"),
        "confidence", passed.alias("passed"))


def check_conversations(turns: DataFrame, expected: DataFrame) -> DataFrame:
    """(scenario, passed): every expected turn must show its topic, phrase and subtopic.

    ``turns`` and ``expected`` are keyed by (scenario, message_index); null expectations are not
    checked.  A missing turn fails.
    """
    joined = expected.join(turns, ["scenario", "message_index"], "left")
    names = F.transform("subtopics", lambda s: s["name"])
    ok = (F.col("general").eqNullSafe(F.col("expected_general"))
          & (F.col("expected_phrase").isNull()
             | F.col("phrase").eqNullSafe(F.col("expected_phrase")))
          & (F.col("expected_subtopic").isNull()
             | F.coalesce(F.array_contains(names, F.col("expected_subtopic")), F.lit(False))))
    return joined.groupBy("scenario").agg(F.bool_and(ok).alias("passed"))


def latency_report(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median and 95th percentile of a numeric column."""
    return metrics.exact_quantiles(df, value, [0.5, 0.95], by)

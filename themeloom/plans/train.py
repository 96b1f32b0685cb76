"""Train both models, pick one, calibrate it, choose its threshold, refit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.functions import decisions as D
from themeloom.operators import calibration, features, linear, metrics
from themeloom.operators.features import Counted, Ngrams
from themeloom.operators.linear import TopicModel
from themeloom.operators.softmax import SoftmaxTrainer, early_stop, train_softmax
from themeloom.session import materialize
from themeloom.sources.model_store import fingerprint


@dataclass
class Training:
    model: TopicModel
    grid: DataFrame
    history: list[tuple[int, float]]
    scores: dict[str, float]


def macro_f1(model: TopicModel, rows: DataFrame, labels: Sequence[str], id_col: str,
             text_col: str, counts: dict[str, Counted] | None = None) -> float:
    """Macro F1 of the best guess over the general labels."""
    p = model.probabilities(rows, id_col, text_col, ["general"], counts)
    pairs = p.select(F.col("general").alias("true"),
                     D.top(D.marginals(F.col("probabilities"), model.classes))["name"]
                     .alias("pred"))
    return metrics.summary(metrics.pair_counts(pairs), labels, digits=12).first()["macro_f1"]


def train(records: DataFrame, labels: Sequence[str], blocks: Sequence[Ngrams] | None = None,
          id_col: str = "doc_id", text_col: str = "text", other: str = K.OTHER_LABEL,
          epochs: int = K.SOFTMAX_MAX_EPOCHS,
          alpha: float = K.NB_ALPHA, commit: str | None = None,
          trainer: type[SoftmaxTrainer] = SoftmaxTrainer) -> Training:
    """``records`` hold the splits train, val and ood_val; test data is never read.

    ``trainer`` is full-batch descent or ``batches.BatchTrainer``.

    Naive Bayes and softmax regression meet on validation macro F1 (softmax wins ties); the
    chosen model's temperature comes from val, its threshold from val and ood_val, and it is then
    fitted again on train and val together.
    """
    blocks = tuple(blocks or features.default_blocks())
    named = records.withColumn("label", D.joint_label(F.col("general"), F.col("subtopic")))
    part = {s: named.filter(F.col("split") == s) for s in ("train", "val", "ood_val")}
    counts = features.count_terms(part["train"], blocks, id_col, text_col, ["label"])
    vectorizer = features.fit(part["train"], blocks, id_col, text_col, counts)
    vectorizer.vocabulary = materialize(vectorizer.vocabulary)

    bayes = linear.train_naive_bayes(part["train"], blocks, alpha, True, id_col, text_col,
                                     vectorizer=vectorizer, counts=counts)
    unknown = part["val"].filter(~F.col("label").isin(*bayes.classes)).select("label").first()
    if unknown:
        raise ValueError(f"validation has a class that train lacks: {unknown.label}")
    fitting = trainer(part["train"], vectorizer, id_col, text_col, counts=counts)
    tried = features.count_terms(part["val"], blocks, id_col, text_col)
    best_epochs, softmax, history = early_stop(
        fitting.steps(epochs), lambda m: macro_f1(m, part["val"], labels, id_col, text_col, tried))
    scores = {"naive_bayes": macro_f1(bayes, part["val"], labels, id_col, text_col, tried),
              "softmax": max(v for _, v in history)}
    use_softmax = scores["softmax"] >= scores["naive_bayes"]
    chosen = softmax if use_softmax else bayes

    tuning = part["val"].unionByName(part["ood_val"])
    logits = materialize(chosen.logits(tuning, id_col, text_col, ["general", "label", "split"]))
    known = F.array(*[F.lit(c) for c in chosen.classes])
    targets = logits.filter(F.col("split") == "val").withColumn(
        "target", (F.array_position(known, F.col("label")) - 1).cast("int"))
    temperature = calibration.fit_temperature(targets)
    best = D.top(D.marginals(D.softmax(F.col("logits"), temperature), chosen.classes))
    scored = logits.select(F.col("general").alias("true"), best.alias("b")).select(
        "true", F.col("b.name").alias("top"), F.col("b.score").alias("confidence"))
    grid = materialize(metrics.threshold_grid(scored, labels, other=other))
    threshold = metrics.best_threshold(grid)

    whole = part["train"].unionByName(part["val"])
    if use_softmax:
        final = train_softmax(whole, blocks, best_epochs, id_col, text_col, trainer=trainer)
    else:
        final = linear.train_naive_bayes(whole, blocks, alpha, True, id_col, text_col)
    final = final.with_decision(temperature, threshold)
    algorithm = "softmax_regression" if use_softmax else "multinomial_naive_bayes"
    sizes = {r["split"]: r["n"] for r in records.groupBy("split").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    final.metadata = {
        "model_name": f"topics-{algorithm}", "model_version": K.MODEL_VERSION,
        "training_timestamp": datetime.now(UTC).isoformat(timespec="seconds"),
        "algorithm": algorithm,
        "dataset": {"version": commit[:12] if commit else "bilinmiyor",
                    **{s: sizes.get(s, 0) for s in ("train", "val", "ood_val")}},
        "features": vectorizer.vocabulary.count(),
        "hyperparameters": {"nb_alpha": alpha, "l2": K.SOFTMAX_L2, "epochs": best_epochs},
        "metrics": {"val_macro_f1_naive_bayes": round(scores["naive_bayes"], 4),
                    "val_macro_f1_softmax": round(scores["softmax"], 4)},
        "thresholds": {"min_confidence": threshold, "temperature": round(temperature, 4)},
        "weights_sha256": fingerprint(final),
    }
    return Training(final, grid, history, scores)

"""Classification, calibration and rejection metrics as DataFrames.

Each report first counts (true, predicted) pairs, which is combined map-side and leaves at most
labels x labels rows; everything after that works on the small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.functions.binding import let
from themeloom.operators.joins import running_total
from themeloom.session import materialize


def pair_counts(pairs: DataFrame, true_col: str = "true", pred_col: str = "pred",
                by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by, F.col(true_col).alias("true"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def label_union(pairs: DataFrame) -> DataFrame:
    """All labels that occur as truth or prediction."""
    return pairs.select(F.col("true").alias("label")).union(
        pairs.select(F.col("pred").alias("label"))).distinct()


def _labels(spark, labels: Sequence[str], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))


def confusion(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every (true, pred) cell over the fixed labels, empty cells as 0."""
    cells = _labels(counts.sparkSession, labels, "true").select(
        "true", F.explode(F.array(*[F.lit(x) for x in labels])).alias("pred"))
    return (cells.join(counts, ["true", "pred"], "left")
            .select("true", "pred", F.coalesce("n", F.lit(0)).alias("n")))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support); only pairs inside ``labels`` count."""
    inside = counts.filter(F.col("true").isin(*labels) & F.col("pred").isin(*labels))
    zero = F.lit(0).cast("long")
    sides = inside.select(*by, F.explode(F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"),
                 zero.alias("predicted"),
                 F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("tp")))).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    spark = counts.sparkSession
    base = counts.select(*by).distinct() if by else spark.range(1).select()
    wanted = base.select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    full = wanted.join(sums, [*by, "label"], "left").na.fill(0, ["support", "predicted", "tp"])
    scored = (full.withColumn("precision", safe_divide(F.col("tp"), F.col("predicted")))
              .withColumn("recall", safe_divide(F.col("tp"), F.col("support"))))
    p, r = F.col("precision"), F.col("recall")
    return scored.select(*by, "label", "precision", "recall",
                         safe_divide(p * r * 2, p + r).alias("f1"), "support")


def summary(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = (),
            digits: int = 4) -> DataFrame:
    """n and accuracy over all pairs; macro and weighted averages over all given labels."""
    keys = list(by) or ["_all"]
    tagged = counts if by else counts.withColumn("_all", F.lit(1))
    overall = tagged.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("_hits"))
    averages = class_report(tagged, labels, keys).groupBy(*keys).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("macro_f1"),
        safe_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    joined = overall.join(averages, keys)
    return joined.select(
        *by, "n", F.round(F.col("_hits") / F.col("n"), digits).alias("accuracy"),
        *[F.round(c, digits).alias(c)
          for c in ("precision_macro", "recall_macro", "macro_f1", "weighted_f1")])


def calibration_edges(n_bins: int = 15) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def calibration_error(scored: DataFrame, confidence: str = "confidence", correct: str = "correct",
                      n_bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins (low, high].

    A confidence of 0 falls into no bin but still counts in the total.
    """
    edges = F.array(*[F.lit(e) for e in calibration_edges(n_bins)])
    c = F.col(confidence).cast("double")
    below = let(c, lambda x: F.size(F.filter(edges, lambda e: e < x)))
    binned = scored.groupBy(below.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.avg(c).alias("confidence"))
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    inside = F.col("bin").between(1, n_bins)
    return binned.agg(
        F.coalesce(F.sum(F.when(inside, gap).otherwise(0.0)) / F.sum("n"), F.lit(0.0))
        .alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def threshold_counts(scored: DataFrame, thresholds: Sequence[float], other: str = K.OTHER_LABEL,
                     true_col: str = "true", top_col: str = "top",
                     confidence: str = "confidence") -> DataFrame:
    """(threshold, true, pred, n) for every threshold from one pass over the rows.

    Rows are counted by (true, top, number of thresholds passed) first; only that small table is
    multiplied by the grid.
    """
    ordered = sorted(thresholds)
    grid = F.array(*[F.lit(float(t)) for t in ordered])
    passed = let(F.col(confidence), lambda c: F.size(F.filter(grid, lambda t: t <= c)))
    small = scored.groupBy(F.col(true_col).alias("true"), F.col(top_col).alias("_top"),
                           passed.alias("_passed")).agg(F.count(F.lit(1)).alias("_n"))
    spread = small.select("*", F.posexplode(grid).alias("_i", "threshold"))
    pred = F.when((F.col("_top") != other) & (F.col("_passed") > F.col("_i")), F.col("_top"))
    return spread.groupBy("threshold", "true", F.coalesce(pred, F.lit(other)).alias("pred")).agg(
        F.sum("_n").alias("n"))


def threshold_grid(scored: DataFrame, labels: Sequence[str],
                   thresholds: Sequence[float] = K.CONFIDENCE_GRID,
                   other: str = K.OTHER_LABEL, **columns: str) -> DataFrame:
    return summary(threshold_counts(scored, thresholds, other, **columns), labels, ["threshold"])


def best_threshold(grid: DataFrame) -> float:
    """Highest macro F1; the lower threshold wins a tie."""
    return grid.orderBy(F.desc("macro_f1"), "threshold").first()["threshold"]


def status_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def subtopic_accuracy(decided: DataFrame, general: str = "general",
                      subtopic: str = "true_subtopic") -> DataFrame:
    """Share of right subtopics where the general topic is right and a subtopic exists."""
    usable = decided.filter((F.col("argmax") == F.col(general)) & (F.col(subtopic) != ""))
    right = F.coalesce(F.col("subtopic") == F.col(subtopic), F.lit(False))
    return usable.agg(F.count(F.lit(1)).alias("n"),
                      F.round(F.avg(right.cast("double")), 4).alias("subtopic_accuracy"))


def rejection(decided: DataFrame) -> DataFrame:
    """Share of unseen-topic rows for which no topic was claimed."""
    accepted = F.avg((F.col("status") == K.STATUS_OK).cast("double"))
    return decided.agg(F.count(F.lit(1)).alias("n"),
                       F.round(F.lit(1.0) - accepted, 4).alias("rejected_rate"))


def worst_categories(decided: DataFrame, category: str = "category", limit: int = 6) -> DataFrame:
    """Categories with the highest share of falsely accepted rows."""
    rates = decided.groupBy(category).agg(
        F.avg((F.col("status") == K.STATUS_OK).cast("double")).alias("_rate"))
    return rates.orderBy(F.desc("_rate"), category).limit(limit).select(
        category, F.round("_rate", 3).alias("false_accept"))


def source_recall(decided: DataFrame, source: str = "source", target: str = "general") -> DataFrame:
    """Per source with one target topic: recall of the best guess and of the accepted label."""
    return decided.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.min(target).alias("target"),
        F.round(F.avg((F.col("argmax") == F.col(target)).cast("double")), 4)
        .alias("recall_argmax"),
        F.round(F.avg((F.col("label") == F.col(target)).cast("double")), 4)
        .alias("recall_with_threshold"))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float],
                    by: Sequence[str] = (), n_buckets: int = 256) -> DataFrame:
    """(by, probability, value): exact quantiles with linear interpolation.

    Equal values are counted together first, and written.  Approximate quantiles of each group cut
    its values into buckets; ranks run inside (by, bucket) and start from the totals of lower
    buckets, so no task sees all values of a group.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    counted = materialize(rows.filter(F.col(value).isNotNull()).groupBy(
        *keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(
        "_v", [i / n_buckets for i in range(1, n_buckets)], 4 * n_buckets).alias("_cuts"))
    bucketed = counted.join(cuts, keys).withColumn("_bucket", let(F.col("_v"), lambda v: F.size(
        F.filter("_cuts", lambda b: b < v)))).drop("_cuts")
    ranked = running_total(bucketed, keys, "_bucket", [F.col("_v")], F.col("_n"), "_last")
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    wanted = totals.select(
        *keys, F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"),
        "_total").withColumn("_rank", F.col("probability") * (F.col("_total") - 1))
    # Zero-based positions first..last-1 hold the value; a quantile needs floor and ceil of a rank.
    spans = ranked.select(*keys, "_v", (F.col("_last") - F.col("_n")).alias("_from"),
                          F.col("_last").alias("_to"))
    hit = spans.join(F.broadcast(wanted) if not by else wanted, keys).filter(
        (F.ceil("_rank") >= F.col("_from")) & (F.floor("_rank") < F.col("_to")))
    low = F.max(F.when(F.floor("_rank") >= F.col("_from"), F.col("_v")))
    high = F.max("_v")
    out = hit.groupBy(*keys, "probability", "_rank").agg(low.alias("_low"), high.alias("_high"))
    part = F.col("_rank") - F.floor("_rank")
    return out.select(*by, "probability", (F.col("_low") + (F.col("_high") - F.col("_low")) * part)
                      .alias("value"))

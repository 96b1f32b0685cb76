"""Cards to training splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.operators import dataset, similarity
from themeloom.operators.dataset import RECORD_COLUMNS, Taxonomy


def build_splits(cards: DataFrame, taxonomy: Taxonomy, order_col: str, source: str = "cards",
                 external: DataFrame | None = None,
                 targets: Mapping[str, tuple[str, str | None]] | None = None,
                 seed: int = K.SEED) -> DataFrame:
    """All records with ``split``: train (with taxonomy seeds), val, test, ood_val, ood_unseen,
    external."""
    records = dataset.to_records(cards, taxonomy, source, [order_col])
    clean = dataset.dedup_conflicts(records, order_col)
    splits = dataset.split_records(clean, seed, other=taxonomy.other).select(
        *RECORD_COLUMNS, "split")
    seeds = dataset.taxonomy_seeds(cards.sparkSession, taxonomy).withColumn("split", F.lit("train"))
    out = splits.unionByName(seeds.select(*RECORD_COLUMNS, "split"))
    if external is not None:
        rows = dataset.external_records(external, targets or {}, seed=seed)
        out = out.unionByName(rows.select(*RECORD_COLUMNS, F.lit("external").alias("split")))
    return out


def split_report(records: DataFrame, near: bool = True) -> dict[str, DataFrame]:
    """Distribution, leakage counts and near-copy rates of written splits."""
    report = {"distribution": dataset.split_distribution(records),
              "leakage": dataset.leakage_counts(records)}
    if near:
        train = records.filter(F.col("split") == "train")
        for name in ("val", "test", "external"):
            rows = records.filter(F.col("split") == name).withColumn(
                "id", F.monotonically_increasing_id())
            report[f"near_copies_{name}"] = similarity.near_copy_rate(
                similarity.near_copies(train, rows))
    return report


def write_report(report: Mapping[str, DataFrame], folder: str) -> None:
    for name, table in report.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")

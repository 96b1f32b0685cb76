"""Labelled cards to clean, leak-free training sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom import constants as K
from themeloom.functions import decisions as D
from themeloom.functions import text
from themeloom.operators.joins import seeded_order
from themeloom.operators.splitting import nested_split
from themeloom.session import materialize

RECORD_COLUMNS = ("text", "general", "subtopic", "category", "term", "group", "source")


@dataclass(frozen=True)
class Taxonomy:
    """Category -> (general, subtopic) with exclusions and pattern overrides.

    A hand-kept table of a few dozen rows, so it is held here and broadcast.
    """

    categories: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: dict(K.CATEGORY_TOPICS))
    excluded: tuple[str, ...] = K.EXCLUDED_CATEGORIES
    # (category, term pattern, (general, subtopic)); wins over the table
    overrides: tuple[tuple[str, str, tuple[str, str]], ...] = (
        (K.OVERRIDE_CATEGORY, K.OVERRIDE_PATTERN, K.OVERRIDE_TOPIC),)
    topics: tuple[str, ...] = K.GENERAL_TOPICS
    other: str = K.OTHER_LABEL

    @property
    def labels(self) -> list[str]:
        return [*self.topics, self.other]

    def subtopics_of(self, general: str) -> list[str]:
        pairs = [*self.categories.values(), *(o[2] for o in self.overrides)]
        return sorted({s for g, s in pairs if g == general})

    def hierarchy(self, spark: SparkSession) -> DataFrame:
        """(general, subtopic): every valid pair."""
        rows = [(g, s) for g in self.topics for s in self.subtopics_of(g)]
        return spark.createDataFrame(rows, "general string, subtopic string")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, g, s, False) for c, (g, s) in self.categories.items()]
        rows += [(c, None, None, True) for c in self.excluded]
        return spark.createDataFrame(
            rows, "category string, general string, subtopic string, excluded boolean")


def valid_hierarchy(pairs: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Rows whose subtopic really belongs to their general topic."""
    valid = taxonomy.hierarchy(pairs.sparkSession)
    return pairs.join(F.broadcast(valid), ["general", "subtopic"], "left_semi")


def map_labels(cards: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Add general, subtopic and excluded.

    Order of rules: excluded category, pattern override, table, out-of-taxonomy label.
    """
    table = taxonomy.table(cards.sparkSession).withColumnsRenamed(
        {"general": "_general", "subtopic": "_subtopic", "excluded": "_excluded"})
    joined = cards.join(F.broadcast(table), "category", "left")
    excluded = F.coalesce(F.col("_excluded"), F.lit(False))
    general: Column = F.coalesce(F.col("_general"), F.lit(taxonomy.other))
    subtopic: Column = F.col("_subtopic")
    for category, pattern, (g, s) in reversed(taxonomy.overrides):
        hit = (F.col("category") == category) & F.col("term").rlike("(?iu)" + pattern)
        general = F.when(hit, F.lit(g)).otherwise(general)
        subtopic = F.when(hit, F.lit(s)).otherwise(subtopic)
    return joined.select(
        *cards.columns, F.when(~excluded, general).alias("general"),
        F.when(~excluded, subtopic).alias("subtopic"), excluded.alias("excluded"))


def to_records(cards: DataFrame, taxonomy: Taxonomy, source: str | Column,
               keep: Sequence[str] = ()) -> DataFrame:
    """Cards with a definition, mapped, without excluded ones, as training records."""
    mapped = map_labels(cards.filter(F.col("definition") != ""), taxonomy)
    src = F.lit(source) if isinstance(source, str) else source
    return mapped.filter(~F.col("excluded")).select(
        *keep, F.concat_ws(" ", "term", "definition").alias("text"), "general", "subtopic",
        "category", "term", text.term_group(F.col("term")).alias("group"), src.alias("source"))


def text_key(column: Column) -> Column:
    """What equal texts have in common: a hash of the normal form."""
    return F.sha2(text.normalize(column), 256)


def dedup_conflicts(records: DataFrame, order_col: str, key: str | None = None) -> DataFrame:
    """One row per normalised text; texts with two different labels are dropped altogether.

    ``order_col`` is unique and says which copy came first; ``key`` names a column that already has
    the ``text_key``, and then no text is read.  The keys are reduced by a combined
    aggregation over (text hash, first id, lowest label, highest label), so a text copied
    millions of times costs one row per map task; the rows to keep are then picked by id.
    """
    label = D.joint_label(F.col("general"), F.col("subtopic"))
    keyed = records.select(
        order_col, (F.col(key) if key else text_key(F.col("text"))).alias("_key"),
        label.alias("_label"))
    first = keyed.groupBy("_key").agg(
        F.min(order_col).alias(order_col), F.min("_label").alias("_lo"), F.max("_label")
        .alias("_hi"))
    return records.join(first.filter(F.col("_lo") == F.col("_hi")).select(order_col), order_col,
                        "left_semi")


def cleaning_counts(cards: DataFrame, taxonomy: Taxonomy, order_col: str) -> DataFrame:
    """raw_rows, excluded rows, duplicates or conflicts removed, rows after cleaning."""
    mapped = map_labels(cards, taxonomy)
    defined = F.col("definition") != ""
    counts = mapped.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(defined & F.col("excluded")).alias("excluded_ambiguous_rows"),
        F.count_if(defined & ~F.col("excluded")).alias("_records"))
    kept = dedup_conflicts(to_records(cards, taxonomy, "", [order_col]), order_col).agg(
        F.count(F.lit(1)).alias("rows_after_cleaning"))
    one = F.lit(1)
    return counts.withColumn("_k", one).join(kept.withColumn("_k", one), "_k").select(
        "raw_rows", "excluded_ambiguous_rows",
        (F.col("_records") - F.col("rows_after_cleaning")).alias("duplicates_or_conflicts_removed"),
        "rows_after_cleaning")


def sample_categories(categories: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` categories in seeded order (a distributed top-k)."""
    return categories.orderBy(seeded_order(seed, F.col("category")), "category").limit(size)


def unseen_categories(records: DataFrame, seed: int = K.SEED,
                      fraction: float = K.UNSEEN_OOD_FRACTION,
                      other: str = K.OTHER_LABEL) -> DataFrame:
    """(category, role): out-of-taxonomy categories kept from training.

    ``fraction`` of them is drawn (rounded half to even); half of those, rounded down, tune the
    threshold ("ood_val"), the rest only evaluate ("ood_unseen").
    """
    names = materialize(records.filter(F.col("general") == other).select("category").distinct())
    drawn = round(names.count() * fraction)
    unseen = sample_categories(names, drawn, seed)
    val = sample_categories(unseen, drawn // 2, seed + 1)
    return unseen.join(val.withColumn("role", F.lit("ood_val")), "category", "left").select(
        "category", F.coalesce("role", F.lit("ood_unseen")).alias("role"))


def split_records(records: DataFrame, seed: int = K.SEED, test: float = K.TEST_SIZE,
                  val: float = K.VAL_SIZE, fraction: float = K.UNSEEN_OOD_FRACTION,
                  other: str = K.OTHER_LABEL) -> DataFrame:
    """Records with ``split``: train, val, test (by term group) and ood_val, ood_unseen.

    Out-of-taxonomy rows whose term group also occurs in seen data are dropped.  The records are
    written first: categories, groups and rows each read them.
    """
    records = materialize(records)
    unseen = unseen_categories(records, seed, fraction, other)
    tagged = records.join(unseen, "category", "left")
    seen = tagged.filter(F.col("role").isNull()).drop("role")
    ood = tagged.filter(F.col("role").isNotNull()).withColumnRenamed("role", "split")
    ood = ood.join(seen.select("group").distinct(), "group", "left_anti")
    columns = [*records.columns, "split"]
    return nested_split(seen, test, val, seed, "group", "category").select(*columns).unionByName(
        ood.select(*columns))


def taxonomy_seeds(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """Short records made of the topic names themselves; for training only."""
    pairs = taxonomy.hierarchy(spark)
    g, s = F.col("general"), F.col("subtopic")
    texts = pairs.select(g, s, F.explode(F.array(s, g, F.concat_ws(" ", g, s))).alias("text"))
    return texts.select(
        "text", "general", "subtopic", F.lit(K.SEED_CATEGORY).alias("category"),
        F.col("text").alias("term"), F.concat(F.lit(K.SEED_CATEGORY + ":"), g).alias("group"),
        F.lit(K.SEED_SOURCE).alias("source"))


def sentence_sample(texts: DataFrame, source_col: str = "source", text_col: str = "text",
                    per_source: int = K.EXTERNAL_SAMPLE_PER_SOURCE, seed: int = K.SEED,
                    low: int = K.EXTERNAL_MIN_WORDS, high: int = K.EXTERNAL_MAX_WORDS) -> DataFrame:
    """(source, sentence, i): a seeded sample of distinct sentences of fitting length.

    The rank filter is a grouped top-k, which Spark also applies before the exchange, so a
    source with most of the sentences sends only ``per_source`` rows per map task.
    """
    parts = texts.select(F.col(source_col).alias("source"),
                         F.explode(text.sentences(F.col(text_col))).alias("sentence"))
    fitting = parts.filter(text.word_count(F.col("sentence")).between(low, high)).distinct()
    rank = F.row_number().over(Window.partitionBy("source").orderBy(
        seeded_order(seed, F.col("sentence")), F.col("sentence")))
    return fitting.withColumn("_rank", rank).filter(F.col("_rank") <= per_source).select(
        "source", "sentence", (F.col("_rank") - 1).alias("i"))


def external_records(texts: DataFrame, targets: Mapping[str, tuple[str, str | None]],
                     **options) -> DataFrame:
    """External evaluation records: every source has one target topic and its own groups."""
    spark = texts.sparkSession
    rows = [(s, g, t) for s, (g, t) in targets.items()]
    table = spark.createDataFrame(rows, "source string, general string, subtopic string")
    wanted = texts.join(F.broadcast(table.select("source")), "source", "left_semi")
    sample = sentence_sample(wanted, **options)
    return sample.join(F.broadcast(table), "source").select(
        F.col("sentence").alias("text"), "general", "subtopic", F.col("source").alias("category"),
        F.lit("").alias("term"), F.concat_ws(":", "source", "i").alias("group"), "source")


def split_distribution(records: DataFrame) -> DataFrame:
    """(split, general, n); the row with a null general holds the size of the split."""
    return records.rollup("split", "general").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("split").isNotNull())


def leakage_counts(records: DataFrame, others: Sequence[str] = ("val", "test"),
                   key: str | None = None) -> DataFrame:
    """(split, shared_groups, shared_texts) between train and each other split; ``key`` names a
    column that already has the ``text_key``."""
    wanted = records.filter(F.col("split").isin("train", *others))
    keys = wanted.select("split", F.explode(F.array(
        F.struct(F.lit("group").alias("kind"), F.col("group").alias("key")),
        F.struct(F.lit("text").alias("kind"),
                 (F.col(key) if key else text_key(F.col("text"))).alias("key")))).alias("k"))
    # One row per key with the splits it occurs in: a combined aggregation, no join of rows.
    splits = keys.groupBy("k.kind", "k.key").agg(
        F.max(F.col("split") == "train").alias("_train"),
        *[F.max(F.col("split") == s).alias(s) for s in others])
    shared = splits.filter("_train").agg(*[
        F.count_if(F.col(s) & (F.col("kind") == kind)).alias(f"{s}_{kind}")
        for s in others for kind in ("group", "text")])
    return shared.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(f"{s}_group").alias("shared_groups"),
                 F.col(f"{s}_text").alias("shared_texts")) for s in others])).alias("r")
    ).select("r.*")

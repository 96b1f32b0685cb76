"""Card files, question-answering paragraphs and split files."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from themeloom import constants as K
from themeloom.functions import text
from themeloom.operators.dataset import RECORD_COLUMNS
from themeloom.session import materialize
from themeloom.sources.json_arrays import CORRUPT, OBJECT, OTHER, read_arrays

logger = logging.getLogger(__name__)

RECORD_SCHEMA = StructType([StructField(c, StringType()) for c in RECORD_COLUMNS])


class DatasetError(RuntimeError):
    """Input is missing or not of the expected form."""


def _checked(spark: SparkSession, folder: str, keys: Sequence[str], pattern: str) -> DataFrame:
    """Elements of all files with the required fields that each lacks (all, if it is no object)."""
    items = materialize(read_arrays(spark, folder, pattern))
    wanted = F.array(*[F.lit(k) for k in keys])
    present = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    return items.withColumn("lacking", F.when(F.col("state") == OBJECT, F.filter(
        wanted, lambda k: ~F.array_contains(present, k))).when(F.col("state") == OTHER, wanted))


def card_problems(spark: SparkSession, folder: str, keys: Sequence[str] = K.CARD_KEYS,
                  pattern: str = "*.json") -> DataFrame:
    """(path, position, problem, lacking): corrupt files, by their first corrupt place, and every
    card without a required field."""
    items = _checked(spark, folder, keys, pattern)
    corrupt = items.filter(F.col("state") == CORRUPT).groupBy("path").agg(
        F.min("position").alias("position"), F.lit("corrupt").alias("problem"),
        F.lit(None).cast("array<string>").alias("lacking"))
    fields = items.filter(F.size("lacking") > 0).join(corrupt.select("path"), "path", "left_anti")
    return corrupt.unionByName(fields.select(
        "path", "position", F.lit("fields").alias("problem"), "lacking"))


def read_cards(spark: SparkSession, folder: str, keys: Sequence[str] = K.CARD_KEYS,
               expected: int | None = None, pattern: str = "*.json") -> DataFrame:
    """(path, position, category, term, definition) from a folder of JSON-array files.

    Files are split among tasks (``json_arrays``).  Corrupt files and cards without a required
    field raise; a payload that is no array is skipped.  (path, position) is the original order.
    """
    items = _checked(spark, folder, keys, pattern)
    bad = items.filter(F.col("state") == CORRUPT).select("path").first()
    if bad:
        raise DatasetError(f"corrupt JSON file: {bad.path}")
    bad = items.filter(F.size("lacking") > 0).select("path", "lacking").first()
    if bad:
        raise DatasetError(f"{bad.path}: missing fields {bad.lacking}")
    items = items.filter(F.col("state") == OBJECT)
    schema = StructType([StructField(k, StringType()) for k in keys])
    parsed = items.select("path", "position", F.from_json("value", schema).alias("c"))
    names = ("category", "term", "definition")
    cards = parsed.select("path", "position", *[
        text.strip(F.coalesce(F.col(f"c.`{k}`"), F.lit("None"))).alias(n)
        for k, n in zip(keys, names, strict=True)])
    if expected is not None:
        found = cards.count()
        if found != expected:
            logger.warning("expected %d cards, found %d", expected, found)
    return cards


def read_paragraphs(spark: SparkSession, folder: str, source: str,
                    pattern: str = "*.json") -> DataFrame:
    """(source, text) of every paragraph in question-answering files."""
    schema = "data array<struct<paragraphs:array<struct<context:string>>>>"
    raw = (spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
           .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder))
    paragraphs = raw.select(F.explode("data.paragraphs").alias("p")).select(
        F.explode("p.context").alias("text"))
    return paragraphs.select(F.lit(source).alias("source"), "text")


def write_splits(records: DataFrame, folder: str, fmt: str = "json") -> None:
    """One folder per split; JSON lines by default, Parquet for large sets."""
    records.write.mode("overwrite").partitionBy("split").format(fmt).save(folder)


def read_split(spark: SparkSession, folder: str, split: str, fmt: str = "json") -> DataFrame:
    """Records of one split; only its folder is listed and read.  Blank lines are skipped."""
    try:
        return spark.read.schema(RECORD_SCHEMA).format(fmt).load(f"{folder}/split={split}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise DatasetError(f"{folder}/split={split} not found; build the data first") from error
        raise

"""The relational side: model registry, sessions, texts, themes, search results.

Tables are Parquet folders; rows are only ever appended.  Constraints a database would enforce on
write are checks that return the violating rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("model_metadata", "sessions", "texts", "themes", "search_results", "search_cache")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    return spark.read.parquet(f"{root}/{table}")


def append(df: DataFrame, root: str, table: str) -> None:
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    df.write.mode("append").parquet(f"{root}/{table}")


def count_rows(spark: SparkSession, root: str, table: str) -> int:
    return read_table(spark, root, table).count()


def insert_or_ignore(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; of equal new keys the first by ``order``."""
    fresh = new.join(existing.select(key), key, "left_anti")
    first = F.min_by(F.struct(*new.columns), F.col(order))
    return fresh.groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).select("_row.*")


def sessions_of(messages: DataFrame, keys: Sequence[str], ts: str, closed: Column) -> DataFrame:
    """Opened at the first event; ended once, at the first closing event, else still open."""
    return messages.groupBy(*keys).agg(
        F.min(ts).alias("started_at"), F.min(F.when(closed, F.col(ts))).alias("ended_at"))


def close_sessions(sessions: DataFrame, at: Column) -> DataFrame:
    """Set the end only where it is not set yet."""
    return sessions.withColumn("ended_at", F.coalesce("ended_at", at))


def sorted_json(value: Column) -> Column:
    """JSON text of a map with its keys in order and characters kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def text_rows(turns: DataFrame, model_version: str | None) -> DataFrame:
    """Stored form of scored messages."""
    return turns.select(
        "session_id", "message_index", "text", "status",
        F.col("general").alias("general_topic"), "confidence", "subtopics",
        F.col("general_scores").alias("scores"), F.lit(model_version).alias("model_version"),
        F.current_timestamp().alias("created_at"))


def theme_rows(turns: DataFrame) -> DataFrame:
    """Stored form of the theme after each message; keyed like its text."""
    return turns.select(
        "session_id", "message_index", "theme_label", F.col("phrase").alias("theme_phrase"),
        F.transform("topics", lambda t: F.struct(t["name"].alias("topic"),
                                                 F.round(t["score"], 4).alias("share")))
        .alias("topics"), F.col("query").alias("search_query"),
        F.current_timestamp().alias("created_at"))


def search_rows(outcomes: DataFrame) -> DataFrame:
    """One row per result with its rank from 1; stored again on a cache hit (from_cache = 1)."""
    return outcomes.select(
        "session_id", "message_index", "search_query",
        F.posexplode("results").alias("_pos", "r"), "from_cache").select(
        "session_id", "message_index", "search_query", (F.col("_pos") + 1).alias("rank"), "r.*",
        F.col("from_cache").cast("int").alias("from_cache"))


def session_history(texts: DataFrame, themes: DataFrame, keys: Sequence[str] = ("session_id",),
                    index: str = "message_index") -> DataFrame:
    """Texts with the theme that followed each; texts without one stay (left join)."""
    return texts.join(themes, [*keys, index], "left")


def history_label(status: Column, general: Column, top_guess: Column,
                  note: str = "en olası") -> Column:
    """Shown label, followed by the best guess where it differs from it."""
    same = (status == "ok") | general.eqNullSafe(top_guess)
    return F.when(same, general).otherwise(
        F.concat(general, F.lit(f" ({note}: "), top_guess, F.lit(")")))


def session_results(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Search rows of the given sessions with ``pos``, their place in the order of storing.

    A session has a few results for each message; they are ranked by themselves.
    """
    order = Window.partitionBy("session_id").orderBy("message_index", "rank")
    return results.join(sessions.select("session_id").distinct(), "session_id", "left_semi"
                        ).withColumn("pos", F.row_number().over(order))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing; a null reference is allowed."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def null_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column, nulls) of required columns, one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in required]))
        .alias("r")).select("r.*")

"""The words of a text that weigh most for a topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom import constants as K
from themeloom.functions import text
from themeloom.functions.decisions import split_class
from themeloom.operators.linear import TopicModel


def topic_keywords(model: TopicModel, docs: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", general_col: str = "general",
                   limit: int = K.KEYWORD_LIMIT, min_weight: float = K.KEYWORD_MIN_WEIGHT,
                   stopwords: Sequence[str] = K.STOPWORDS, block: str = "word") -> DataFrame:
    """(id, general, keywords): tokens with the highest learned weight for the row's topic.

    A token weighs what its stem weighs in the best class of that topic.  Distinct tokens are
    joined to the weights and ranked by a grouped top-k.
    """
    classes: dict[str, list[int]] = {}
    for i, c in enumerate(model.classes):
        classes.setdefault(split_class(c)[0], []).append(i)
    weight = F.lit(None).cast("double")
    for general, at in classes.items():
        best = F.array_max(F.array(*[F.col("w")[i] for i in at]))
        weight = F.when(F.col(general_col) == general, best).otherwise(weight)
    prepared = docs.select(id_col, general_col, text.normalize(F.col(text_col)).alias("_norm"))
    tokens = (
        prepared.select(id_col, general_col, F.posexplode(text.words(F.col("_norm")))
                        .alias("_pos", "token"))
        .filter((F.length("token") > 2) & ~F.col("token").isin(*stopwords))
        .groupBy(id_col, general_col, "token").agg(F.min("_pos").alias("_pos"))
        .withColumn("term", text.f5_stem(F.col("token")))
    )
    weights = model.terms.filter(F.col("analyzer") == block).select("term", "w")
    scored = tokens.join(weights, "term").select(
        id_col, general_col, "token", "_pos", weight.alias("_weight")).filter(
        F.col("_weight") >= min_weight)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("_weight"), "_pos"))
    top = scored.withColumn("_rank", rank).filter(F.col("_rank") <= limit)
    lists = top.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "token"))), lambda s: s["token"])
        .alias("keywords"))
    return docs.select(id_col, general_col).join(lists, id_col, "left").select(
        id_col, general_col, F.coalesce("keywords", F.array().cast("array<string>"))
        .alias("keywords"))

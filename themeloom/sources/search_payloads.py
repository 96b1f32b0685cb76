"""Search provider payloads to result rows, and the choice between providers.

Payloads are JSON text columns.  Items are flattened as JSON text and parsed one by one, so an
item of an unexpected shape never spoils its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom import constants as K
from themeloom.functions import text
from themeloom.session import materialize

_NO_ITEMS = "array<string>"


def _items(json: Column) -> Column:
    """Elements of a JSON array as texts; anything else has none."""
    return F.coalesce(F.from_json(F.when(F.json_array_length(json).isNotNull(), json), _NO_ITEMS),
                      F.array().cast(_NO_ITEMS))


def _has(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def _text(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def payload_error(payload: Column) -> Column:
    """Error text of a payload that is no object or reports an error; null if it is usable."""
    code = F.coalesce(_text(payload, "error.code"), _text(payload, "error"))
    return (F.when(F.json_object_keys(payload).isNull(), F.lit("not an object"))
            .when(_has(payload, "error"), F.concat(F.lit("api error: "),
                                                   F.coalesce(code, F.lit("null")))))


def _result_rows(found: DataFrame, id_col: str, limit: int, source: str) -> DataFrame:
    """Rank usable candidates of each query; the rank filter is a grouped top-k."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("_order", "_pos"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit).select(
        id_col, "rank", "title", "summary", "url", F.lit(source).alias("source"))


def encyclopedia_results(payloads: DataFrame, id_col: str = "query_id", payload: str = "payload",
                         limit: int = K.MAX_RESULTS, hosts=K.ALLOWED_HOSTS) -> DataFrame:
    """(id, rank, title, summary, url, source) of encyclopedia search payloads.

    Pages come as an array or as an object keyed by id; they are ordered by their ``index``, pages
    without one last, and pages that are missing, untitled or on a foreign host are left out.
    """
    usable = payloads.filter(payload_error(F.col(payload)).isNull())
    pages_json = _text(F.col(payload), "query.pages")
    as_object = F.map_values(F.from_json(
        F.when(F.json_object_keys(pages_json).isNotNull(), pages_json), "map<string,string>"))
    pages = F.coalesce(as_object, _items(pages_json))
    page = F.col("_page")
    items = usable.select(id_col, F.posexplode(pages).alias("_pos", "_page")).filter(
        F.json_object_keys(page).isNotNull())
    missing = _text(page, "missing")
    rows = items.select(
        id_col, "_pos",
        F.coalesce(F.expr("try_cast(get_json_object(_page, '$.index') as double)"),
                   F.lit(float(K.MISSING_RESULT_INDEX))).alias("_order"),
        text.clean_text(_text(page, "title"), K.MAX_TITLE_CHARS).alias("title"),
        text.clean_text(_text(page, "extract"), K.MAX_SUMMARY_CHARS).alias("summary"),
        F.coalesce(F.nullif(_text(page, "fullurl"), F.lit("")), _text(page, "canonicalurl"))
        .alias("url"),
        F.coalesce(missing.isin("", "false", "0"), missing.isNull()).alias("_there"))
    good = rows.filter((F.col("title") != "") & F.col("_there")
                       & text.allowed_url(F.col("url"), hosts))
    return _result_rows(good, id_col, limit, "wikipedia")


def _leaves(topics: DataFrame, id_col: str) -> DataFrame:
    """(id, _pos, _leaf): what no group holds any more, with its path through the groups.

    ``topics``: id and an array of JSON texts.  Groups are opened level by level until none is
    left; paths sort in document order.
    """
    rows = materialize(topics.select(id_col, F.posexplode("_topics").alias("_at", "_leaf")).select(
        id_col, F.array("_at").alias("_pos"), "_leaf"))
    found = None
    while True:
        group = _has(F.col("_leaf"), "Topics")
        done = rows.filter(~group)
        found = done if found is None else found.unionByName(done)
        groups = rows.filter(group)
        if groups.isEmpty():
            return found
        rows = materialize(groups.select(id_col, "_pos", F.posexplode(
            _items(_text(F.col("_leaf"), "Topics"))).alias("_at", "_leaf")).select(
                id_col, F.array_append("_pos", F.col("_at")).alias("_pos"), "_leaf"))


def answer_results(payloads: DataFrame, id_col: str = "query_id", payload: str = "payload",
                   limit: int = K.MAX_RESULTS, hosts=K.ALLOWED_HOSTS) -> DataFrame:
    """(id, rank, title, summary, url, source) of instant-answer payloads.

    The abstract comes first, then related topics in document order, groups opened depth-first
    however deep they are.
    """
    p = F.col(payload)
    usable = payloads.filter(F.json_object_keys(p).isNotNull())
    abstract_url = _text(p, "AbstractURL")
    abstract = usable.select(
        id_col, F.lit(0.0).alias("_order"), F.array().cast("array<int>").alias("_pos"),
        F.coalesce(F.nullif(_text(p, "Heading"), F.lit("")), abstract_url).alias("_title"),
        _text(p, "AbstractText").alias("_text"), abstract_url.alias("url"))
    leaf = F.col("_leaf")
    related = _leaves(usable.select(id_col, _items(_text(p, "RelatedTopics")).alias("_topics")),
                      id_col).filter(F.json_object_keys(leaf).isNotNull()).select(
        id_col, F.lit(1.0).alias("_order"), "_pos",
        F.split(_text(leaf, "Text"), " - ", 2)[0].alias("_title"),
        _text(leaf, "Text").alias("_text"), _text(leaf, "FirstURL").alias("url"))
    both = abstract.unionByName(related).filter(
        (F.col("_text") != "") & text.allowed_url(F.col("url"), hosts))
    rows = both.select(
        id_col, "_order", "_pos",
        text.clean_text(F.col("_title"), K.MAX_TITLE_CHARS).alias("title"),
        text.clean_text(F.col("_text"), K.MAX_SUMMARY_CHARS).alias("summary"), "url")
    return _result_rows(rows, id_col, limit, "duckduckgo")


def choose_provider(outcomes: DataFrame, id_col: str = "query_id", priority: str = "priority",
                    provider: str = "provider", status: str = "status") -> DataFrame:
    """(id, status, provider): the first provider with results.

    Without any: offline if all were, empty if all answered without results, else an error.
    """
    s = F.col(status)
    agg = outcomes.groupBy(id_col).agg(
        F.min_by(F.when(s == K.STATUS_OK, F.col(provider)),
                 F.when(s == K.STATUS_OK, F.col(priority))).alias("provider"),
        F.bool_and(s == K.STATUS_OFFLINE).alias("_offline"),
        F.bool_and(s == K.STATUS_EMPTY).alias("_empty"))
    return agg.select(
        id_col, F.when(F.col("provider").isNotNull(), K.STATUS_OK)
        .when(F.col("_offline"), K.STATUS_OFFLINE).when(F.col("_empty"), K.STATUS_EMPTY)
        .otherwise(K.STATUS_ERROR).alias("status"), "provider")

"""Messages to predictions, themes and search queries; queries to stored results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.functions import phrases, text
from themeloom.functions.decisions import general_names, split_class
from themeloom.operators import conversation, keywords, linear, replay
from themeloom.operators.linear import TopicModel
from themeloom.operators.search_replay import HIT, MADE, replay_searches
from themeloom.session import materialize
from themeloom.sources import search_payloads

SESSION_KEYS = ("conv_id", "session_no")


def _is_control(message: Column) -> Column:
    """Words that steer the program and say nothing: they take no part in the chat."""
    return F.coalesce(text.is_command(text.strip(message), (
        *K.EXIT_COMMANDS, *K.HISTORY_COMMANDS, *K.HELP_COMMANDS)), F.lit(False))


def empty_messages(messages: DataFrame, reset: Column | None = None,
                   stopwords: Sequence[str] = K.STOPWORDS) -> DataFrame:
    """(conv_id, turn, text, status, warnings) of messages without content: they are not scored,
    and whoever wrote them is told so.  Control words and resets are not among them."""
    message = F.col("text")
    reset = text.is_command(text.strip(message), K.RESET_COMMANDS) if reset is None else reset
    quiet = ~text.has_content(text.normalize(message), stopwords) & ~reset & ~_is_control(message)
    return messages.filter(quiet).select(
        "conv_id", "turn", "text", F.lit(K.STATUS_EMPTY).alias("status"),
        F.array(F.lit("no content")).alias("warnings"))


def process_messages(model: TopicModel, messages: DataFrame, reset: Column | None = None,
                     stopwords: Sequence[str] = K.STOPWORDS, other: str = K.OTHER_LABEL,
                     forms: phrases.Forms = K.TOPIC_FORMS,
                     heads: Mapping[str, str] = K.MEDIUM_HEADS, decay: float = K.DECAY,
                     min_weight: float = K.KEYWORD_MIN_WEIGHT,
                     max_chars: int | None = K.MAX_INPUT_CHARS) -> DataFrame:
    """One row per message with content: prediction, theme, query and warnings.

    ``messages`` has conv_id, turn (unique in a conversation) and text.
    """
    reset = text.is_command(text.strip(F.col("text")), K.RESET_COMMANDS) if reset is None else reset
    shown = text.strip(F.col("text")) if max_chars is None else text.clip(
        F.col("text"), max_chars)["text"]
    content = text.has_content(text.normalize(shown), stopwords) & ~_is_control(F.col("text"))
    kept = conversation.segment_sessions(messages, reset, content).withColumn(
        "message_id", F.concat_ws(":", "conv_id", "turn"))
    scored = linear.predict(model, kept, "message_id", "text", max_chars, stopwords, other,
                            keep=["conv_id", "session_no", "message_index"])
    subs = [s for s in map(split_class, model.classes) if s[1]]
    running = conversation.conversation_scores(
        scored.withColumns({"_g": F.col("general_scores"), "_j": F.col("joint_subtopic_scores")}),
        SESSION_KEYS, "message_index", general_names(model.classes), subs, decay, "_g", "_j")
    themed = conversation.themes(running, other, forms=forms, heads=heads)
    in_theme = F.array_contains(F.transform("topics", lambda t: t["name"]), F.col("top_guess"))
    asked = themed.select("message_id", "text", F.when(in_theme, F.col("top_guess"))
                          .alias("_topic"))
    found = keywords.topic_keywords(model, asked, "message_id", "text", "_topic",
                                    min_weight=min_weight, stopwords=stopwords)
    full = themed.join(found.select("message_id", "keywords"), "message_id")
    warnings = F.when(F.col("truncated"), F.array(F.lit("truncated"))).otherwise(
        F.array().cast("array<string>"))
    return conversation.search_queries(full).withColumn("warnings", warnings).drop(
        "scores", "sub_scores")


def ingest_searches(queries: DataFrame, answers: DataFrame, service: str | None = None,
                    ttl_hours: float = K.CACHE_TTL_HOURS,
                    cooldown_seconds: float = K.OFFLINE_COOLDOWN_SECONDS,
                    limit: int = K.MAX_RESULTS) -> DataFrame:
    """Search rows of every query under the result cache and the pause after a failure.

    ``queries``: query_id, query, ts and the ``service`` column, if pauses hold for all queries of a
    service.  ``answers`` is what each query meets if it is asked: query_id, provider, priority,
    payload and outcome ("payload", "offline" or "error"); those of queries that are not asked have
    no effect.  The cache key is the normalised query.  A hit has the rows of the query that stored
    them, ``from_cache`` 1, that query as ``source_id`` and its time as ``cached_us``.  A query
    without results has one row that says why; its rank is null.  ``asked`` says whether a provider
    was asked.
    """
    payloads = answers.filter(F.col("outcome") == "payload").select(
        F.struct("query_id", "provider").alias("_answer"), "provider", "payload")
    results = _parsed(payloads, limit)
    have = results.groupBy("_answer").agg(F.count(F.lit(1)).alias("_n"))
    outcomes = answers.withColumn("_answer", F.struct("query_id", "provider")).join(
        have, "_answer", "left").withColumn("status", _outcome())
    chosen = search_payloads.choose_provider(outcomes, "query_id")
    keyed = materialize(queries.withColumn("query_key", text.normalize(F.col("query"))).join(
        chosen, "query_id", "left"))
    done = materialize(replay_searches(keyed, "query_key", "ts", "query_id", "status", service,
                                       ttl_hours, cooldown_seconds))
    found = results.select(F.col("_answer.query_id").alias("source_id"),
                           F.col("_answer.provider").alias("source"), "rank", "title", "summary",
                           "url")
    # An answer's rows are those of its chosen provider.
    found = found.join(keyed.select(F.col("query_id").alias("source_id"),
                                    F.col("provider").alias("source")), ["source_id", "source"])
    asked = queries.select("query_id", "query").join(done.drop("query_key"), "query_id")
    return asked.join(found, "source_id", "left").select(
        "query_id", "query", "status", "rank", "title", "summary", "url", "source",
        (F.col("state") == HIT).cast("int").alias("from_cache"),
        (F.col("state") == MADE).alias("asked"), "source_id", "cached_us")


def _parsed(payloads: DataFrame, limit: int) -> DataFrame:
    """Ranked results of (_answer, provider, payload), each provider's payloads by its own rules."""
    wiki = search_payloads.encyclopedia_results(
        payloads.filter(F.col("provider") == "wikipedia"), "_answer", limit=limit)
    ddg = search_payloads.answer_results(
        payloads.filter(F.col("provider") == "duckduckgo"), "_answer", limit=limit)
    return wiki.unionByName(ddg)


def _outcome() -> Column:
    """Status of one provider's answer, from its outcome, payload and number of results _n."""
    failed = search_payloads.payload_error(F.col("payload")).isNotNull()
    return (F.when(F.col("outcome") == "offline", K.STATUS_OFFLINE)
            .when(F.col("_n") > 0, K.STATUS_OK)
            .when((F.col("outcome") == "error") | failed, K.STATUS_ERROR)
            .otherwise(K.STATUS_EMPTY))


def ingest_results(queries: DataFrame, answers: DataFrame, ttl_hours: float = K.CACHE_TTL_HOURS,
                   limit: int = K.MAX_RESULTS) -> DataFrame:
    """Search rows of every query: ranked results of the provider that answered, marked by cache.

    ``queries``: query_id, query, ts.  ``answers``: query_key, provider, priority, payload and
    outcome ("payload", "offline" or "error").  The cache key is the normalised query; rows are
    stored again on a hit.  A query without results has one row that says why: offline, empty or
    error, and error where no answer was given at all; its rank is null.
    """
    keyed = queries.withColumn("query_key", text.normalize(F.col("query")))
    payloads = answers.filter(F.col("outcome") == "payload").select(
        F.concat_ws("|", "query_key", "provider").alias("_answer"), "provider", "payload")
    results = _parsed(payloads, limit)
    have = results.groupBy("_answer").agg(F.count(F.lit(1)).alias("_n"))
    outcomes = answers.withColumn("_answer", F.concat_ws("|", "query_key", "provider")).join(
        have, "_answer", "left").withColumn("status", _outcome())
    chosen = search_payloads.choose_provider(outcomes, "query_key")
    asked = keyed.join(chosen, "query_key", "left").withColumn(
        "status", F.coalesce("status", F.lit(K.STATUS_ERROR)))
    answered = asked.filter(F.col("status") == K.STATUS_OK)
    cached = replay.replay_cache(answered, "query_key", "ts", "query_id", ttl_hours)
    columns = ["query_id", "query", "status", "rank", "title", "summary", "url",
               F.col("provider").alias("source"), "from_cache"]
    found = (answered.join(cached.select("query_id", F.col("hit").cast("int").alias("from_cache")),
                           "query_id")
             .withColumn("_answer", F.concat_ws("|", "query_key", "provider"))
             .join(results.drop("source"), "_answer").select(*columns))
    without = asked.filter(F.col("status") != K.STATUS_OK).select("query_id", "query", "status")
    return found.unionByName(without.withColumn("from_cache", F.lit(0)), allowMissingColumns=True)

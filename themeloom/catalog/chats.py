"""Registered queries: conversations, themes, search queries and their streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom.catalog.common import (
    FORMS, HEADS, JOINT_CLASSES, OTHER, STOPWORDS, in_list, labelled, nb_ctes, nb_scores, norm,
    query, table, texts, words,
)
from themeloom.functions import phrases, text
from themeloom.functions.decisions import general_names, split_class
from themeloom.operators import conversation, linear
from themeloom.operators.features import word_block
from themeloom.plans import chat
from themeloom.session import materialize, run_folder
from themeloom.sources import chat_store
from themeloom.streaming.running import running_themes
from themeloom.streaming.scoring import store_batches
from themeloom.streaming.themes import stream_scores

MIN_CONFIDENCE = 0.6
MIN_WEIGHT = -8.0          # naive Bayes weights are log probabilities
GENERAL = general_names(JOINT_CLASSES)
SUBTOPICS = [s for s in map(split_class, JOINT_CLASSES) if s[1]]

_CONTENT = (f"length(list_filter(regexp_extract_all({norm('text')}, '[a-zçğıöşüâîû]+'), "
            f"lambda t: length(t) > 1 AND t NOT IN {in_list(STOPWORDS)})) > 0")

# sg: messages with content, their session and index; a system message starts a new session

def _segments_sql(source: str = "conversations", opens: str = "role = 'system'") -> str:
    return f"""
  mk AS (SELECT *, {opens} AS rs, {_CONTENT} AS ct FROM {source}),
  sn AS (SELECT *, sum(rs::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS session_no
         FROM mk),
  sg AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS id, session_no,
           row_number() OVER (PARTITION BY conv_id, session_no ORDER BY turn) AS message_index
         FROM sn WHERE ct AND role <> 'system')"""


_SEGMENTS = _segments_sql()

# ds, dj: decayed topic and joint scores; the messages' probabilities are rounded first
_DECAYED = f"""{_SEGMENTS}, {nb_ctes()}, {nb_scores('sg', 'id')},
  pg AS (SELECT id, general, round(sum(p), 4) AS p FROM qp GROUP BY ALL),
  pj AS (SELECT id, general, subtopic, round(p, 4) AS p FROM qp WHERE subtopic IS NOT NULL),
  ds AS (SELECT id, conv_id, turn, session_no, message_index, general, pow(0.7, message_index) *
      sum(p * pow(0.7, -message_index)) OVER (PARTITION BY conv_id, session_no, general
        ORDER BY message_index) AS s FROM pg JOIN sg USING (id)),
  dj AS (SELECT id, general, subtopic, pow(0.7, message_index) *
      sum(p * pow(0.7, -message_index)) OVER (PARTITION BY conv_id, session_no, general, subtopic
        ORDER BY message_index) AS s FROM pj JOIN sg USING (id))"""

# th: theme of each message
_THEMES = f"""{_DECAYED},
  tt AS (SELECT id, sum(s) FILTER (WHERE general <> '{OTHER}') AS total,
           sum(s) FILTER (WHERE general = '{OTHER}') AS outside FROM ds GROUP BY id),
  sh AS (SELECT id, general, s / total AS share, row_number() OVER (PARTITION BY id ORDER BY s DESC,
           general) AS k FROM ds JOIN tt USING (id)
         WHERE general <> '{OTHER}' AND total > 0 AND outside <= total),
  ch AS (SELECT id, list(general ORDER BY k) AS topics FROM sh
         WHERE (share >= 0.15 AND k <= 3) OR k = 1 GROUP BY id),
  fs AS (SELECT id, arg_min(subtopic, {{'a': -s, 'b': subtopic}}) AS sub, max(s) / sum(s) AS part
         FROM dj JOIN ch USING (id) WHERE length(topics) = 1 AND general = topics[1] GROUP BY id),
  ft AS (SELECT sg.*, coalesce(topics, []) AS topics, topics IS NULL AS uncertain,
           CASE WHEN part >= 0.5 THEN sub END AS focus
         FROM sg LEFT JOIN ch USING (id) LEFT JOIN fs USING (id)),
  th AS (SELECT *, CASE WHEN uncertain THEN 'unsure'
      ELSE array_to_string(topics, ' + ') || coalesce(' > ' || focus, '') END AS theme_label,
    CASE WHEN focus IS NOT NULL THEN focus WHEN uncertain THEN ''
      WHEN list_contains(topics, 'en') AND list_contains(topics, 'fr') THEN
        CASE WHEN list_contains(topics, 'de') THEN 'physics hakkında ' ELSE '' END ||
        'scientific books'
      WHEN list_contains(topics, 'en') THEN
        CASE WHEN list_contains(topics, 'de') THEN 'physics volumes' ELSE 'books' END
      WHEN list_contains(topics, 'fr') AND list_contains(topics, 'de')
        THEN 'physics alanında scientific araştırmalar'
      WHEN list_contains(topics, 'fr') THEN 'science'
      WHEN list_contains(topics, 'de') THEN 'physics' ELSE '' END AS phrase FROM ft)"""


def _segments(spark, sf):
    turns = table(spark, sf, "conversations")
    content = text.has_content(text.normalize(F.col("text")), STOPWORDS)
    return conversation.segment_sessions(turns, F.col("role") == "system", content)


def _model(spark, sf):
    return linear.train_naive_bayes(labelled(spark, sf), [word_block((), 1)]).with_decision(
        1.0, MIN_CONFIDENCE)


def _scored(spark, sf):
    turns = _segments(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return linear.predict(_model(spark, sf), turns, "id", max_chars=None, stopwords=STOPWORDS,
                          other=OTHER, keep=["conv_id", "turn", "session_no", "message_index"])


def _decayed(spark, sf):
    return conversation.conversation_scores(
        _scored(spark, sf).select("conv_id", "turn", "session_no", "message_index",
                                  "general_scores", "joint_subtopic_scores"),
        ["conv_id", "session_no"], "message_index", GENERAL, SUBTOPICS)


def _themes(scores):
    return conversation.themes(scores, OTHER, forms=FORMS, heads=HEADS, uncertain_label="unsure")


@query(f"WITH {_SEGMENTS} SELECT conv_id, turn, session_no, message_index FROM sg")
def session_segments(spark, sf):
    """Conversations cut at system messages; messages without content are not numbered."""
    return _segments(spark, sf).select("conv_id", "turn", "session_no", "message_index")


@query(f"""WITH {_DECAYED} SELECT conv_id, turn, general, round(s, 12) AS score FROM ds""")
def decayed_scores(spark, sf):
    each = _decayed(spark, sf).select("conv_id", "turn", F.explode("scores").alias("s"))
    return each.select("conv_id", "turn", F.col("s.name").alias("general"),
                       F.round("s.score", 12).alias("score"))


_THEME_COLUMNS = ("SELECT conv_id, turn, session_no, message_index, uncertain, theme_label, phrase "
                  "FROM th")


def _theme_columns(themed):
    return themed.select("conv_id", "turn", "session_no", "message_index", "uncertain",
                         "theme_label", "phrase")


@query(f"WITH {_THEMES} {_THEME_COLUMNS}")
def conversation_theme(spark, sf):
    return _theme_columns(_themes(_decayed(spark, sf)))


@query(f"WITH {_THEMES} {_THEME_COLUMNS}")
def stream_theme(spark, sf):
    """The same themes from a stream of scored messages with state per conversation."""
    turns = table(spark, sf, "conversations").withColumn(
        "id", F.col("conv_id") * 1000 + F.col("turn"))
    scored = linear.predict(_model(spark, sf), turns, "id", max_chars=None, stopwords=STOPWORDS,
                            other=OTHER, keep=["conv_id", "turn", "role"]).select(
        "conv_id", "turn", (F.col("role") == "system").alias("reset"), "general_scores",
        "joint_subtopic_scores")
    source = materialize(scored.repartition("conv_id"))
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    scores = stream_scores(stream, GENERAL, SUBTOPICS, idle_ms=None)
    run = store_batches(scores, f"{folder}/out", f"{folder}/state").trigger(
        availableNow=True).start()
    run.awaitTermination()
    return _theme_columns(_themes(spark.read.parquet(f"{folder}/out").filter("not late").drop("batch_id", "late")))


# The last of four deliveries holds a quarter of the turns; those behind another one are late.
_HELD = "turn % 4 = 1"
_CLOCK = "(turn * 60 + turn // 3 * 7200)"
_DELIVERED = f"""
  dl AS (SELECT *, coalesce({_HELD} AND turn < max(turn) FILTER (WHERE NOT {_HELD}) OVER (
      PARTITION BY conv_id), false) AS late FROM conversations)"""


def _delivered(idle: str) -> str:
    """The segments of what came in time; ``idle`` says when a pause opens a session."""
    timely = _segments_sql("pv", f"role = 'system' OR {idle}")
    return _DECAYED.replace(_SEGMENTS, f"""{_DELIVERED},
  pv AS (SELECT *, lag({_CLOCK}) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM dl
         WHERE NOT late),{timely}""")


def _score_columns(idle: str) -> str:
    return f"""WITH {_delivered(idle)} SELECT conv_id, turn, session_no, message_index, late,
    general, round(s, 9) AS score FROM ds JOIN dl USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, NULL, NULL, late, NULL, NULL FROM dl WHERE late"""


def _stream_running(spark, sf, idle_seconds):
    """Raw messages in four deliveries, scored and followed in micro-batches."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.timestamp_seconds(F.col("turn") * 60 + F.floor(F.col("turn") / 3) * 7200).alias("ts"))
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    held = F.col("turn") % 4 == 1
    delivery = F.when(held, 3).otherwise(F.least(F.floor(F.col("turn") / 2), F.lit(2)))
    for i in range(4):
        turns.filter(delivery == i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{folder}/in/*")
    model = _model(spark, sf)

    def score(batch):
        return linear.predict(model, batch, "id", max_chars=None, stopwords=STOPWORDS, other=OTHER,
                              keep=["conv_id", "turn", "role", "ts"]).withColumn(
            "reset", F.col("role") == "system")

    run = running_themes(stream, f"{folder}/out", f"{folder}/state", GENERAL, SUBTOPICS, ts="ts",
                         idle_seconds=idle_seconds, score=score).trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.parquet(f"{folder}/out/turns")
    each = done.select("conv_id", "turn", F.when(~F.col("late"), F.col("session_no")).alias(
        "session_no"), "message_index", "late", F.explode_outer("scores").alias("s"))
    return each.select("conv_id", "turn", "session_no", "message_index", "late",
                       F.col("s.name").alias("general"), F.round("s.score", 9).alias("score"))


@query(_score_columns("false"))
def stream_running_scores(spark, sf):
    """Running scores of raw messages over several micro-batches, late turns set aside."""
    return _stream_running(spark, sf, None)


@query(_score_columns(f"coalesce({_CLOCK} - prev > 3600, false)"))
def stream_idle_sessions(spark, sf):
    """The same where an hour without a message ends a session."""
    return _stream_running(spark, sf, 3600)


# kt: keywords of each message for its best general topic, if that is part of the theme
_KEYWORDS = f"""{_THEMES},
  tg AS (SELECT id, arg_min(general, {{'a': -p, 'b': general}}) AS top FROM
         (SELECT id, general, sum(p) AS p FROM qp GROUP BY ALL) GROUP BY id),
  tk AS (SELECT id, token, min(pos) AS pos FROM (SELECT id, unnest(ws) AS token,
           unnest(range(length(ws))) AS pos FROM (SELECT id, {words(norm('text'))} AS ws FROM sg))
         WHERE length(token) > 2 AND token NOT IN {in_list(STOPWORDS)} GROUP BY ALL),
  tm AS (SELECT tk.*, top FROM tk JOIN tg USING (id) JOIN th USING (id)
         WHERE list_contains(topics, top)),
  kw AS (SELECT tm.id, token, pos, max(ln(coalesce(t, 0) + 0.001) - z) AS w
         FROM tm JOIN voc ON voc.term = substring(token, 1, 5)
         JOIN nz ON split_part(nz.label, ' > ', 1) = top
         LEFT JOIN tot ON tot.term = voc.term AND tot.label = nz.label GROUP BY ALL),
  kr AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, pos) AS k
         FROM kw WHERE w >= {MIN_WEIGHT}),
  kt AS (SELECT id, list(token ORDER BY k) AS keywords FROM kr WHERE k <= 4 GROUP BY id)"""


def _processed(spark, sf):
    turns = table(spark, sf, "conversations")
    return chat.process_messages(_model(spark, sf), turns, F.col("role") == "system", STOPWORDS,
                                 OTHER, FORMS, HEADS, min_weight=MIN_WEIGHT, max_chars=None)


@query(f"""WITH {_KEYWORDS} SELECT conv_id, turn, coalesce(array_to_string(keywords, ' '), '')
    AS keywords FROM sg LEFT JOIN kt USING (id)""")
def keywords_topk(spark, sf):
    """Up to four keywords of each message (the operator ranks and cuts)."""
    done = _processed(spark, sf)
    return done.select("conv_id", F.split("message_id", ":")[1].cast("long").alias("turn"),
                       F.array_join("keywords", " ").alias("keywords"))


_FINITE = ("([ıiuü]yor(um|sun|uz|lar)?|(d|[çfhkpsşt]t)[ıiuü](m|n|k|nız|niz|lar|ler)?|"
           "[mn][ıiuü]ş([ıiuü]m|lar|ler)?|[ae]c[ae]k([ıi]m|lar|ler)?)$")


def _form(token: str) -> str:
    cut = f"regexp_replace({token}, '(y?l[ae]|[dt][ae]n|[dt][ae])$', '')"
    return (f"CASE WHEN length({token}) >= 5 AND regexp_matches({token}, '{_FINITE}') THEN NULL "
            f"WHEN length({cut}) >= 4 THEN {cut} ELSE {token} END")


@query(f"""SELECT token, {_form('token')} AS form FROM (SELECT DISTINCT
    unnest({words(norm('text'))}) AS token FROM documents)""")
def query_forms(spark, sf):
    """Search form of every distinct word of the documents."""
    tokens = texts(spark, sf, "documents").select(
        text.normalize(F.col("text")).alias("n")).select(
        F.explode(text.words(F.col("n"))).alias("token")).distinct()
    return tokens.select("token", phrases.query_form(F.col("token")).alias("form"))


# bq: words of each message's query, taken one after the other
_QUERIES = f"""{_KEYWORDS},
  bs AS (SELECT id, list_filter({words(norm('coalesce(focus, phrase)'))},
           lambda w: w NOT IN ('alanında', 've')) AS ws, uncertain,
           list_filter(list_transform(coalesce(keywords, []), lambda t: {_form('t')}),
             lambda f: f IS NOT NULL AND f <> '') AS fs
         FROM th LEFT JOIN kt USING (id)),
  bq AS (SELECT id, ws, fs, uncertain, CASE WHEN length(ws) >= 3 THEN 0 ELSE 2 END AS budget,
           1 AS i FROM bs
         UNION ALL
         SELECT id, CASE WHEN fresh THEN list_append(ws, fs[i]) ELSE ws END, fs, uncertain,
           CASE WHEN fresh THEN budget - 1 ELSE budget END, i + 1 FROM (
             SELECT *, budget > 0 AND NOT list_contains(list_transform(ws,
               lambda w: substring(w, 1, 5)), substring(fs[i], 1, 5)) AS fresh
             FROM bq WHERE i <= length(fs)))"""


@query(f"""WITH RECURSIVE {_QUERIES} SELECT conv_id, turn, CASE WHEN NOT uncertain THEN nullif(array_to_string(ws, ' '), '') END
    AS query FROM bq JOIN sg USING (id) WHERE i = length(fs) + 1""")
def search_queries(spark, sf):
    """The whole turn: prediction, theme, keywords, query."""
    done = _processed(spark, sf)
    return done.select("conv_id", F.split("message_id", ":")[1].cast("long").alias("turn"),
                       "query")


@query(f"""WITH RECURSIVE {_QUERIES} SELECT conv_id || ':' || session_no AS session_id,
    message_index, CASE WHEN th.uncertain THEN 'Belirsiz' ELSE theme_label END AS theme_label,
    phrase AS theme_phrase, length(topics) AS n_topics,
    CASE WHEN NOT th.uncertain THEN nullif(array_to_string(ws, ' '), '') END AS search_query
  FROM th JOIN bq USING (id) WHERE i = length(fs) + 1""")
def stored_turns(spark, sf):
    """Theme rows and text rows of all turns, stored and joined by session and message."""
    done = _processed(spark, sf).withColumn("session_id", F.concat_ws(":", "conv_id", "session_no"))
    root = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    chat_store.append(chat_store.text_rows(done, "v1"), root, "texts")
    chat_store.append(chat_store.theme_rows(done), root, "themes")
    rows = chat_store.session_history(
        chat_store.read_table(spark, root, "texts").select("session_id", "message_index"),
        chat_store.read_table(spark, root, "themes"))
    return rows.select("session_id", "message_index", "theme_label", "theme_phrase",
                       F.size("topics").alias("n_topics"), "search_query")

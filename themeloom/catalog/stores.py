"""Registered queries: search payloads, cache replay, store checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.catalog.common import norm, query, rr, table, texts
from themeloom.functions import text
from themeloom.operators import replay
from themeloom.operators import search_replay as search_replays
from themeloom.plans import chat
from themeloom.session import materialize, run_folder
from themeloom.sources import chat_store, provenance, search_payloads
from themeloom.streaming.cache import stream_cache
from themeloom.streaming.cooldown import stream_cooldown
from themeloom.streaming.scoring import store_batches

HOSTS = ("example.com", "example.org")


def _plain(column: str) -> str:
    t = rr(f"coalesce({column}, '')", r"<[^>]+>", " ")
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return f"trim({rr(t, '\\s+', ' ')})"


def _cut(column: str, limit: int) -> str:
    return (f"CASE WHEN length({column}) > {limit} THEN regexp_replace(substring({column}, 1, "
            f"{limit - 1}), ' [^ ]*$', '') || '…' ELSE {column} END")


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_ALLOWED = (f"(url LIKE 'https://%' AND ({_HOST} IN ('example.com', 'example.org') OR {_HOST} "
            f"LIKE '%.example.com' OR {_HOST} LIKE '%.example.org'))")
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


def _pages(spark, sf):
    return texts(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        "html", F.floor(F.col("page_id") / 5).alias("query_id"))


@query(f"""WITH p AS (SELECT page_id // 5 AS query_id, page_id, url, {_plain(_TITLE)} AS t,
    {_plain('html')} AS s, CASE WHEN page_id % 3 > 0 THEN (page_id * 7) % 5 ELSE 1000 END AS i
    FROM pages),
  g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, page_id) AS rank FROM p
        WHERE t <> '' AND {_ALLOWED} AND page_id % 11 > 0 AND query_id % 17 > 0)
  SELECT query_id, rank, {_cut('t', 150)} AS title, {_cut('s', 400)} AS summary, url FROM g
  WHERE rank <= 3""")
def encyclopedia_results(spark, sf):
    """Payloads made of the pages, as arrays and as objects, some with errors (top 3 each)."""
    pages = _pages(spark, sf)
    index = F.when(F.col("page_id") % 3 > 0, (F.col("page_id") * 7) % 5)
    item = F.struct(
        "title", index.alias("index"), F.col("html").alias("extract"),
        F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("fullurl"),
        F.when(F.col("page_id") % 2 == 1, F.col("url")).alias("canonicalurl"),
        F.when(F.col("page_id") % 11 == 0, F.lit(True)).alias("missing"))
    grouped = pages.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("page_id", item.alias("item")))).alias("rows"))
    as_list = F.to_json(F.struct(F.struct(F.transform("rows", lambda r: r["item"])
                                          .alias("pages")).alias("query")))
    as_map = F.to_json(F.struct(F.struct(F.map_from_entries(F.transform(
        "rows", lambda r: F.struct(r["page_id"].cast("string"), r["item"]))).alias("pages"))
        .alias("query")))
    payload = (F.when(F.col("query_id") % 17 == 0, F.lit('{"error": {"code": "badvalue"}}'))
               .when(F.col("query_id") % 2 == 0, as_list).otherwise(as_map))
    results = search_payloads.encyclopedia_results(
        grouped.select("query_id", payload.alias("payload")), hosts=HOSTS)
    return results.drop("source")


@query(f"""WITH p AS (SELECT page_id // 5 AS query_id, page_id, url, {_TITLE} AS raw, html
    FROM pages),
  x AS (SELECT query_id, 0 AS o, page_id, raw AS title, html AS txt, url FROM p WHERE page_id % 5 = 0
        UNION ALL SELECT query_id, 1, page_id, split_part(raw || ' - ' || html, ' - ', 1),
          raw || ' - ' || html, url FROM p WHERE page_id % 5 > 0),
  g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, page_id) AS rank,
          {_plain('title')} AS t, {_plain('txt')} AS s, url FROM x WHERE {_ALLOWED})
  SELECT query_id, rank, {_cut('t', 150)} AS title, {_cut('s', 400)} AS summary, url FROM g
  WHERE rank <= 3""")
def answer_results(spark, sf):
    """Payloads with an abstract and topics nested up to three groups deep (top 3 each)."""
    pages = _pages(spark, sf)
    leaf = F.to_json(F.struct(F.col("url").alias("FirstURL"),
                              F.concat_ws(" - ", "title", "html").alias("Text")))
    k = F.col("page_id") % 5
    group = F.concat(F.lit('{"Name":"g","Topics":['), leaf, F.lit("]}"))
    nested = F.concat(F.lit('{"Topics":[{"Topics":['), leaf, F.lit("]}]}"))
    item = F.when(k == 1, leaf).when(k == 2, group).when(k > 2, nested)
    first = F.max(F.when(k == 0, F.struct("title", "html", "url")))
    grouped = pages.groupBy("query_id").agg(
        first.alias("a"), F.array_sort(F.collect_list(F.when(k > 0, F.struct(
            "page_id", item.alias("item"))))).alias("rows"))
    head = F.to_json(F.struct(F.col("a.title").alias("Heading"), F.col("a.html")
                              .alias("AbstractText"), F.col("a.url").alias("AbstractURL")))
    payload = F.concat(
        F.regexp_replace(head, "}$", ""), F.lit(',"RelatedTopics":['),
        F.array_join(F.transform("rows", lambda r: r["item"]), ","), F.lit("]}"))
    results = search_payloads.answer_results(grouped.select("query_id", payload.alias("payload")),
                                             hosts=HOSTS)
    return results.drop("source")


@query(f"""WITH p AS (SELECT page_id // 5 AS query_id, page_id, url, {_TITLE} AS raw, html FROM pages),
  g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank,
          {_plain("split_part(raw || ' - ' || html, ' - ', 1)")} AS t, url FROM p WHERE {_ALLOWED})
  SELECT query_id, rank, {_cut('t', 150)} AS title, url FROM g WHERE rank <= 3""")
def answer_results_deep(spark, sf):
    """Each topic inside up to eleven groups, one in the other (top 3 each)."""
    pages = _pages(spark, sf)
    leaf = F.to_json(F.struct(F.col("url").alias("FirstURL"),
                              F.concat_ws(" - ", "title", "html").alias("Text")))
    depth = (F.col("page_id") % 12).cast("int")
    item = F.concat(F.repeat(F.lit('{"Topics":['), depth), leaf, F.repeat(F.lit("]}"), depth))
    grouped = pages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "page_id", item.alias("item")))).alias("rows"))
    payload = F.concat(F.lit('{"RelatedTopics":['), F.array_join(F.transform(
        "rows", lambda r: r["item"]), ","), F.lit("]}"))
    return search_payloads.answer_results(grouped.select("query_id", payload.alias("payload")),
                                          hosts=HOSTS).select("query_id", "rank", "title", "url")


_OUTCOME = """CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'error' THEN 'offline'
    WHEN event_type = 'click' THEN 'error' ELSE 'empty' END"""


@query(f"""WITH o AS (SELECT user_id * 1000 + day(ts) AS query_id, event_id AS priority,
    'p' || (event_id % 3) AS provider, {_OUTCOME} AS status FROM events)
  SELECT query_id, CASE WHEN bool_or(status = 'ok') THEN 'ok' WHEN bool_and(status = 'offline')
      THEN 'offline' WHEN bool_and(status = 'empty') THEN 'empty' ELSE 'error' END AS status,
    arg_min(provider, priority) FILTER (WHERE status = 'ok') AS provider FROM o GROUP BY query_id""")
def provider_fallback(spark, sf):
    """First answering provider per query, and what it means when none answers."""
    e = F.col("event_type")
    status = (F.when(e == "purchase", K.STATUS_OK).when(e == "error", K.STATUS_OFFLINE)
              .when(e == "click", K.STATUS_ERROR).otherwise(K.STATUS_EMPTY))
    outcomes = table(spark, sf, "events").select(
        (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("query_id"),
        F.col("event_id").alias("priority"),
        F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"),
        status.alias("status"))
    return search_payloads.choose_provider(outcomes)


_REPLAY = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (
    PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT event_id, user_id, ts, k, false AS hit, ts AS cached_at FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.user_id, e.ts, e.k, e.ts - r.cached_at <= INTERVAL 24 HOURS,
      CASE WHEN e.ts - r.cached_at <= INTERVAL 24 HOURS THEN r.cached_at ELSE e.ts END
    FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
  SELECT event_id, user_id, hit, epoch_us(cached_at) AS cached_us FROM r"""


@query(_REPLAY)
def cache_replay(spark, sf):
    """Hits and misses of a 24-hour result cache over the event log."""
    log = table(spark, sf, "events")
    out = replay.replay_cache(log, "user_id", "ts", "event_id")
    return out.select("event_id", "user_id", "hit", "cached_us")


@query(_REPLAY.replace("user_id", "event_type"))
def cache_replay_long_keys(spark, sf):
    """The same with very few keys of very many events."""
    log = table(spark, sf, "events")
    out = replay.replay_cache(log, "event_type", "ts", "event_id")
    return out.select("event_id", "event_type", "hit", "cached_us")


@query(_REPLAY)
def stream_cache_replay(spark, sf):
    """The same from a stream with one time stamp of state per key."""
    log = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp")
                                            .alias("ts"))
    source = materialize(log.repartition("user_id"))
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    hits = stream_cache(stream, "user_id", "ts", "event_id")
    run = store_batches(hits, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.parquet(f"{folder}/out").withColumn(
        "cached_at", F.col("cached_at").cast("timestamp_ntz"))
    return done.select("event_id", "user_id", "hit",
                       replay.micros(done, "cached_at").alias("cached_us"))


_COOLDOWN = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, event_type = 'error' AS off,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT event_id, user_id, k, false AS suppressed, CASE WHEN off THEN ts + INTERVAL 6 HOURS
      ELSE TIMESTAMP '1970-01-01' END AS until FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.user_id, e.k, e.ts < r.until, CASE WHEN e.ts >= r.until AND off
      THEN e.ts + INTERVAL 6 HOURS ELSE r.until END
    FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
  SELECT event_id, user_id, suppressed FROM r"""


@query(_COOLDOWN)
def cooldown_suppress(spark, sf):
    """Attempts in the six hours after a failed one are not made."""
    return replay.apply_cooldown(table(spark, sf, "events"), "user_id", "ts", "event_id",
                                 F.col("event_type") == "error", 6 * 3600)


@query(_COOLDOWN)
def stream_cooldown_suppress(spark, sf):
    """The same from a stream in four micro-batches, in event time; a later row closes the log."""
    events = table(spark, sf, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("off"))
    day = F.unix_date(F.to_date("ts"))
    bounds = events.agg(F.min(day).alias("a"), F.max(day).alias("b"), F.max("ts").alias("z")).first()
    days = max((bounds.b - bounds.a + 4) // 4, 1)
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    end = spark.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"),
        (F.lit(bounds.z) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(False).alias("off"))
    deliveries = [*(events.filter(F.floor((day - bounds.a) / days) == i) for i in range(4)), end]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider,
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # A delivery may be many files with all its days in each: they go into one micro-batch, or
        # the watermark of the first would pass the rows of the next.
        for i, delivery in enumerate(deliveries):
            delivery.write.parquet(f"{folder}/in/{i}")
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
            cold = stream_cooldown(stream, "user_id", "ts", "event_id", "off", 6 * 3600, "2 days")
            run = store_batches(cold, f"{folder}/out", f"{folder}/state").trigger(
                availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "suppressed")


_SEARCHES = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, user_id % 20 AS service,
    CASE event_type WHEN 'error' THEN 'offline' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'error'
      ELSE 'empty' END AS met FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY SCOPE ORDER BY ts, event_id) AS k FROM e),
  r AS (SELECT SCOPE AS scope, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id,
      ''::VARCHAR AS state, ''::VARCHAR AS met, NULL::BIGINT AS source_id, NULL::BIGINT AS cached_us,
      MAP {}::MAP(BIGINT, STRUCT(put TIMESTAMP, id BIGINT)) AS cache,
      TIMESTAMP '1970-01-01' AS until FROM (SELECT DISTINCT SCOPE FROM e)
    UNION ALL
    SELECT scope, k, event_id, user_id, state, met, source.id, epoch_us(source.put),
      CASE WHEN state = 'made' AND met = 'ok'
        THEN map_concat(cache, MAP {user_id: {'put': ts, 'id': event_id}}) ELSE cache END,
      CASE WHEN state = 'made' AND met = 'offline' THEN ts + PAUSE ELSE until END
    FROM (SELECT *, CASE WHEN state = 'hit' THEN had
        WHEN state = 'made' AND met = 'ok' THEN {'put': ts, 'id': event_id} END AS source
      FROM (SELECT *, CASE WHEN ts - had.put <= INTERVAL 24 HOURS THEN 'hit' WHEN ts < until
          THEN 'suppressed' ELSE 'made' END AS state
        FROM (SELECT r.scope, o.k, o.event_id, o.user_id, o.met, o.ts, r.cache, r.until,
            map_extract(r.cache, o.user_id)[1] AS had
          FROM r JOIN o ON o.SCOPE = r.scope AND o.k = r.k + 1)))),
  d AS (SELECT event_id, user_id, state, CASE state WHEN 'hit' THEN 'ok' WHEN 'suppressed'
    THEN 'offline' ELSE met END AS status, source_id, cached_us FROM r WHERE k > 0)"""
_BY_USER = _SEARCHES.replace("SCOPE", "user_id").replace("PAUSE", "INTERVAL 6 HOURS")
_BY_SERVICE = _SEARCHES.replace("SCOPE", "service").replace("PAUSE", "INTERVAL 1 HOURS")


def _searches(spark, sf):
    e = F.col("event_type")
    met = (F.when(e == "error", K.STATUS_OFFLINE).when(e == "purchase", K.STATUS_OK)
           .when(e == "click", K.STATUS_ERROR).otherwise(K.STATUS_EMPTY))
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", met.alias("met"), (F.col("user_id") % 20).alias("service"))


@query(f"{_BY_USER} SELECT * FROM d")
def search_replay(spark, sf):
    """Attempts under the result cache and the pause after a failure, both kept by user."""
    return search_replays.replay_searches(_searches(spark, sf), "user_id", "ts", "event_id", "met",
                                          cooldown_seconds=6 * 3600)


@query(f"{_BY_SERVICE} SELECT * FROM d")
def search_replay_services(spark, sf):
    """The same with answers kept by user and pauses that hold for all users of a service."""
    return search_replays.replay_searches(_searches(spark, sf), "user_id", "ts", "event_id", "met",
                                          "service", cooldown_seconds=3600)


@query(f"""{_BY_USER} SELECT event_id AS query_id, status, rank,
    'P' || source_id || '-' || rank AS title, state = 'made' AS asked,
    (state = 'hit')::INT AS from_cache, cached_us
  FROM d LEFT JOIN (SELECT unnest([1, 2, 3]) AS rank) ON rank <= 1 + source_id % 3""")
def search_ingest(spark, sf):
    """Stored result rows of a log of searches: payloads parsed, hits with the earlier answer."""
    asked = _searches(spark, sf)
    listed = F.transform(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 3 + 1), lambda k: F.struct(
        F.concat_ws("-", F.concat(F.lit("P"), F.col("event_id").cast("string")),
                    k.cast("string")).alias("title"), k.alias("index"),
        F.lit("https://tr.wikipedia.org/wiki/P").alias("fullurl")))
    pages = F.when(F.col("met") == K.STATUS_OK, listed).otherwise(F.slice(listed, 1, 0))
    payload = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    answers = asked.select(
        F.col("event_id").alias("query_id"), F.lit("wikipedia").alias("provider"),
        F.lit(1).alias("priority"), payload.alias("payload"),
        F.when(F.col("met").isin(K.STATUS_OFFLINE, K.STATUS_ERROR), F.col("met")).otherwise(
            "payload").alias("outcome"))
    word = F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij")
    queries = asked.select(F.col("event_id").alias("query_id"), F.concat(F.lit("Ask "), word).alias(
        "query"), "ts")
    rows = chat.ingest_searches(queries, answers, cooldown_seconds=6 * 3600)
    return rows.select("query_id", "status", "rank", "title", "asked", "from_cache", "cached_us")


@query("""SELECT user_id, event_type, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def cache_upsert(spark, sf):
    """The newest entry of every cache key."""
    entries = table(spark, sf, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("key"), "user_id", "event_type", "ts",
        "event_id", "value")
    return replay.latest_per_key(entries, "key", "ts", "event_id").select(
        "user_id", "event_type", "event_id", "value")


@query(f"""SELECT lang, count(DISTINCT {norm('text')}) AS keys, count(*) AS n FROM documents
  GROUP BY lang""")
def cache_keys(spark, sf):
    """Distinct cache keys when every document is asked as a query."""
    keyed = texts(spark, sf, "documents").select("lang", F.sha2(
        text.normalize(F.col("text")), 256).alias("key"))
    return keyed.groupBy("lang").agg(F.count_distinct("key").alias("keys"),
                                     F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------ store

def _texts(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"),
        F.length("text").alias("chars"))
    answers = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("message_index"),
        F.md5("text").alias("theme_label"))
    return asked, answers


@query("""SELECT u.conv_id AS session_id, u.turn AS message_index, length(u.text) AS chars,
    md5(a.text) AS theme_label FROM conversations u LEFT JOIN conversations a
    ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn - 1 = u.turn
  WHERE u.role = 'user'""")
def session_history(spark, sf):
    """Messages with what followed each; messages without an answer stay."""
    return chat_store.session_history(*_texts(spark, sf))


@query("""SELECT user_id, min(ts)::VARCHAR AS started_at, (min(ts) FILTER (WHERE event_type =
    'error'))::VARCHAR AS ended_at, count(*) AS n FROM events GROUP BY user_id""")
def session_bounds(spark, sf):
    """Sessions opened by the first event and ended once, by the first closing one."""
    events = table(spark, sf, "events")
    bounds = chat_store.sessions_of(events, ["user_id"], "ts", F.col("event_type") == "error")
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    stamp = lambda c: F.col(c).cast("string")
    return bounds.join(counts, "user_id").select(
        "user_id", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"),
        "n")


@query("""SELECT user_id, count(*) AS orphans FROM events WHERE user_id NOT IN
    (SELECT s_suppkey FROM supplier) GROUP BY user_id""")
def fk_violations(spark, sf):
    """Rows that refer to a missing parent."""
    orphans = chat_store.orphans(table(spark, sf, "events"), table(spark, sf, "supplier"),
                                 "user_id", "s_suppkey")
    return orphans.groupBy("user_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("""SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT conv_id, NULL, count(*) FROM conversations GROUP BY conv_id, turn
  HAVING count(*) > 1""")
def unique_violations(spark, sf):
    """Keys that occur more than once."""
    turns = table(spark, sf, "conversations")
    role = chat_store.duplicate_keys(turns, ["conv_id", "role"])
    turn = chat_store.duplicate_keys(turns, ["conv_id", "turn"])
    return role.select("conv_id", "role", "n").unionByName(
        turn.select("conv_id", F.lit(None).cast("string").alias("role"), "n"))


@query("""SELECT 'text' AS "column", count(*) - count(text) AS nulls FROM documents
  UNION ALL SELECT 'quality', count(*) - count(quality) FROM documents LEFT JOIN labels
    USING (doc_id)""")
def null_violations(spark, sf):
    """Missing required values, counted in one pass."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return chat_store.null_counts(rows, ["text", "quality"])


@query("""SELECT user_id::VARCHAR AS model_version, min(event_id) AS first_event,
    arg_min(event_type, event_id) AS note FROM events
  WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id""")
def model_registry(spark, sf):
    """New versions are registered once, as first seen; known ones are left alone."""
    new = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("model_version"),
        F.col("event_id").alias("first_event"), F.col("event_type").alias("note"))
    known = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("model_version"))
    return chat_store.insert_or_ignore(new, known, "model_version", "first_event")


@query("""SELECT conv_id, turn, 'r' || k AS title, k AS rank FROM conversations CROSS JOIN
    (SELECT unnest([1, 2, 3]) AS k) WHERE k <= 1 + turn % 3 AND role = 'user'""")
def ranked_results(spark, sf):
    """Result lists stored one row per result, ranks from 1."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    listed = F.transform(F.sequence(F.lit(1).cast("long"), F.col("turn") % 3 + 1), lambda k: F.struct(
        F.concat(F.lit("r"), k.cast("string")).alias("title")))
    outcomes = turns.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"),
        F.lit("q").alias("search_query"), listed.alias("results"), F.lit(False)
        .alias("from_cache"))
    return chat_store.search_rows(outcomes).select(
        F.col("session_id").alias("conv_id"), F.col("message_index").alias("turn"), "title", "rank")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}'
    AS scores FROM c GROUP BY user_id""")
def json_export(spark, sf):
    """Maps as JSON text with sorted keys."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(
        F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", chat_store.sorted_json(F.col("m")).alias("scores"))


@query("""SELECT event_type, CASE WHEN value < 10 THEN event_type WHEN event_type = 'view'
    THEN 'unsure' ELSE 'unsure (best: ' || event_type || ')' END AS label, count(*) AS n
  FROM (SELECT value, event_type FROM events) GROUP BY ALL""")
def history_labels(spark, sf):
    """History lines name the best guess where it differs from the label shown."""
    e = table(spark, sf, "events")
    ok = F.col("value") < 10
    label = chat_store.history_label(
        F.when(ok, "ok").otherwise("uncertain"),
        F.when(ok, F.col("event_type")).otherwise(F.lit("unsure")),
        F.when(F.col("event_type") == "view", F.lit("unsure")).otherwise(F.col("event_type")),
        note="best")
    return e.select("event_type", label.alias("label")).groupBy("event_type", "label").agg(
        F.count(F.lit(1)).alias("n"))


_COUNTED = ("documents", "labels", "conversations", "pages", "events", "embeddings")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts(spark, sf):
    counts = None
    for t in _COUNTED:
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(t).alias("tbl"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


_DIGESTS = """(SELECT 'doc/' || doc_id AS path, doc_id, source, octet_length(encode(text)) AS bytes,
    sha256(text) AS sha256 FROM documents)"""


def _digests(spark, sf):
    """Documents as delivered files: path, size and hash."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "source",
        F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query(f"""SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'extra' WHEN doc_id % 11 = 0 THEN 'mismatch'
    ELSE 'ok' END AS state FROM {_DIGESTS}
  UNION ALL SELECT 'item/' || item_id, 'missing' FROM benchmark""")
def manifest_check(spark, sf):
    """Hashes of all documents against a manifest with wrong, missing and additional entries."""
    files = _digests(spark, sf)
    wrong = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.col("sha256"), 256)).otherwise(
        F.col("sha256"))
    manifest = files.filter("doc_id % 13 <> 0").select("path", wrong.alias("sha256"))
    gone = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"))
    return provenance.check_manifest(files, manifest.unionByName(gone))


@query(f"""SELECT source, count(*) AS files, sum(bytes)::BIGINT AS bytes,
    sum(('0x' || substring(sha256(path || '|' || sha256), 1, 12))::BIGINT)::VARCHAR AS digest
  FROM {_DIGESTS} GROUP BY source""")
def file_provenance(spark, sf):
    """Files, bytes and an order-free digest of what each source delivered."""
    return provenance.provenance(_digests(spark, sf))


@query("""SELECT conv_id, turn, 'r' || k AS title, row_number() OVER (PARTITION BY conv_id ORDER BY
    turn, k) AS pos FROM conversations CROSS JOIN (SELECT unnest([1, 2, 3]) AS k)
  WHERE k <= 1 + turn % 3 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def session_results(spark, sf):
    """Search rows of all sessions with a system message, in the order they were stored."""
    turns = table(spark, sf, "conversations")
    listed = F.transform(F.sequence(F.lit(1).cast("long"), F.col("turn") % 3 + 1), lambda k: F.struct(
        F.concat(F.lit("r"), k.cast("string")).alias("title")))
    stored = chat_store.search_rows(turns.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"),
        F.lit("q").alias("search_query"), listed.alias("results"), F.lit(False)
        .alias("from_cache")))
    sessions = turns.filter("role = 'system'").select(F.col("conv_id").alias("session_id"))
    rows = chat_store.session_results(stored, sessions)
    return rows.select(F.col("session_id").alias("conv_id"),
                       F.col("message_index").alias("turn"), "title", "pos")

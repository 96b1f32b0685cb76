from __future__ import annotations

import json

from pyspark.sql import functions as F

from themeloom.plans import chat
from themeloom.sources import chat_store
from themeloom.sources import search_payloads as sp

WIKI = {"query": {"pages": [
    {"title": "Mercan", "index": 2, "extract": "Kıyı <b>Kayalık</b> yeri.",
     "fullurl": "https://tr.wikipedia.org/wiki/Mercan"},
    {"title": "Deniz feneri", "index": 1, "extract": "Aygıt.",
     "fullurl": "https://tr.wikipedia.org/wiki/Deniz_feneri"},
    {"title": "Yabancı", "index": 3, "fullurl": "https://tr.wikipedia.org.sahte.example/a"},
    "text", 7,
    {"title": "Yok", "index": 0, "missing": True, "fullurl": "https://tr.wikipedia.org/wiki/Y"},
    {"title": "Fok &amp; yunuslar", "index": 4, "fullurl": "",
     "canonicalurl": "https://tr.wikipedia.org/wiki/Fok"},
    {"title": "Sırasız", "fullurl": "https://tr.wikipedia.org/wiki/S"}]}}
DDG = {"AbstractText": "Özet.", "AbstractURL": "https://tr.wikipedia.org/wiki/K",
       "Heading": "Deniz feneri", "RelatedTopics": [
           {"FirstURL": "https://duckduckgo.com/Coral", "Text": "Mercan - Canlı - iki."},
           {"Name": "Alt", "Topics": [
               {"Topics": [{"FirstURL": "https://duckduckgo.com/Reef", "Text": "Resif - x"}]},
               {"FirstURL": "http://duckduckgo.com/plain", "Text": "Düz - y"}]},
           {"FirstURL": "https://duckduckgo.com/Z", "Text": "Son"}, {"Topics": "yok"}, 3]}


def payloads(spark, *items):
    return spark.createDataFrame(
        [(i, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
         for i, v in enumerate(items)], "query_id int, payload string")


def test_encyclopedia(spark):
    as_map = {"query": {"pages": {str(i): p for i, p in enumerate(WIKI["query"]["pages"])}}}
    df = payloads(spark, WIKI, as_map, {"batchcomplete": True},
                  {"error": {"code": "toolong"}}, ["liste"], "{broken")
    rows = sp.encyclopedia_results(df, limit=5).orderBy("query_id", "rank").collect()
    titles = ["Deniz feneri", "Mercan", "Fok & yunuslar", "Sırasız"]
    assert [(r.query_id, r["rank"], r.title) for r in rows] == [
        (q, i + 1, t) for q in (0, 1) for i, t in enumerate(titles)]
    assert rows[1].summary == "Kıyı Kayalık yeri." and rows[2].url.endswith("/Fok")
    assert sp.encyclopedia_results(df, limit=1).count() == 2
    errors = [r[0] for r in df.orderBy("query_id").select(sp.payload_error(F.col("payload")))
              .collect()]
    assert errors[:3] == [None] * 3 and "toolong" in errors[3]
    assert errors[4:] == ["not an object"] * 2


def test_answers(spark):
    df = payloads(spark, DDG, {"RelatedTopics": []}, [1])
    rows = sp.answer_results(df, limit=5).orderBy("rank").collect()
    assert [r.title for r in rows] == ["Deniz feneri", "Mercan", "Resif", "Son"]
    assert rows[1].summary == "Mercan - Canlı - iki."
    assert [r.title for r in sp.answer_results(df, limit=2).orderBy("rank").collect()] == [
        "Deniz feneri", "Mercan"]


def test_answers_at_any_depth(spark):
    leaf = lambda n: {"FirstURL": f"https://duckduckgo.com/{n}", "Text": f"T{n} - x"}
    item = leaf(2)
    for _ in range(15):
        item = {"Topics": [item]}
    df = payloads(spark, {"RelatedTopics": [leaf(1), {"Topics": [item, leaf(3)]}, leaf(4)]})
    rows = sp.answer_results(df, limit=9).orderBy("rank").collect()
    assert [r.title for r in rows] == ["T1", "T2", "T3", "T4"]


def test_provider_choice(spark):
    rows = [(1, 1, "w", "offline"), (1, 2, "d", "ok"), (2, 1, "w", "offline"),
            (2, 2, "d", "offline"), (3, 1, "w", "empty"), (3, 2, "d", "empty"),
            (4, 1, "w", "empty"), (4, 2, "d", "offline"), (5, 1, "w", "ok"), (5, 2, "d", "ok")]
    df = spark.createDataFrame(rows, "query_id int, priority int, provider string, status string")
    assert {r.query_id: (r.status, r.provider) for r in sp.choose_provider(df).collect()} == {
        1: ("ok", "d"), 2: ("offline", None), 3: ("empty", None), 4: ("error", None),
        5: ("ok", "w")}


def test_ingest(spark):
    queries = spark.sql("""SELECT * FROM VALUES (1, 'Deniz  Feneri', timestamp'2024-01-01'),
      (2, 'deniz feneri!', timestamp'2024-01-01 05:00:00'),
      (3, 'deniz feneri', timestamp'2024-01-03'), (4, '???', timestamp'2024-01-01'),
      (5, 'görülmemiş', timestamp'2024-01-01') AS t(query_id, query, ts)""")
    answers = spark.createDataFrame(
        [("deniz feneri", "wikipedia", 1, json.dumps({"query": {}}), "payload"),
         ("deniz feneri", "duckduckgo", 2, json.dumps(DDG), "payload"),
         ("görülmemiş", "wikipedia", 1, None, "offline")],
        "query_key string, provider string, priority int, payload string, outcome string")
    rows = chat.ingest_results(queries, answers).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.from_cache) for r in rows if r["rank"]] == [
        (q, k, int(q == 2)) for q in (1, 2, 3) for k in (1, 2, 3)]
    assert {r.source for r in rows if r["rank"]} == {"duckduckgo"}
    assert [(r.query_id, r.status) for r in rows if not r["rank"]] == [(4, "error"),
                                                                       (5, "offline")]


def test_store(spark, tmp_path):
    root = str(tmp_path)
    texts = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s2", 1, "c"), ("zz", 1, "d"),
                                   ("s1", 2, "e")], "session_id string, message_index int, text string")
    chat_store.append(texts, root, "texts")
    assert chat_store.count_rows(spark, root, "texts") == 5
    sessions = spark.createDataFrame([("s1",), ("s2",)], "session_id string")
    assert [r.text for r in chat_store.orphans(texts, sessions, "session_id", "session_id")
            .collect()] == ["d"]
    assert [tuple(r) for r in chat_store.duplicate_keys(
        texts, ["session_id", "message_index"]).collect()] == [("s1", 2, 2)]
    new = spark.createDataFrame([("1", "x", 0), ("2", "y", 2), ("2", "z", 1)],
                                "v string, n string, at int")
    fresh = chat_store.insert_or_ignore(new, new.filter("v = '1'"), "v", "at")
    assert [tuple(r) for r in fresh.collect()] == [("2", "z", 1)]
    closed = chat_store.close_sessions(
        spark.createDataFrame([("a", None), ("b", "x")], "s string, ended_at string"), F.lit("z"))
    assert [r.ended_at for r in closed.orderBy("s").collect()] == ["z", "x"]
    row = spark.createDataFrame([({"b": 1, "a": 2},)], "m map<string,int>")
    assert row.select(chat_store.sorted_json(F.col("m"))).first()[0] == '{"a":2,"b":1}'
    for name in ("users", "texts; DROP TABLE x"):
        try:
            chat_store.read_table(spark, root, name)
        except ValueError:
            continue
        raise AssertionError(name)
    themes = spark.createDataFrame([("s1", 1, "Spor")],
                                   "session_id string, message_index int, theme_label string")
    got = chat_store.session_history(texts.filter("session_id = 's1'"), themes)
    assert {(r.message_index, r.theme_label) for r in got.collect()} == {(1, "Spor"), (2, None)}


def test_searches_pause_together_and_hits_have_the_earlier_answer(spark):
    """Two queries of a service meet one failure; the log goes on after the pause."""
    def page(title):
        return json.dumps({"query": {"pages": [
            {"title": title, "fullurl": "https://tr.wikipedia.org/wiki/K"}]}})

    queries = spark.sql("""SELECT *, 'chat' AS service FROM VALUES
      (1, 'Rüzgâr türbini', timestamp'2024-01-01 10:00:00'),
      (2, 'gelgit  enerjisi', timestamp'2024-01-01 10:00:30'),
      (3, 'Gelgit enerjisi!', timestamp'2024-01-01 10:02:00'),
      (4, 'gelgit enerjisi', timestamp'2024-01-02 10:02:00'),
      (5, 'rüzgâr türbini', timestamp'2024-01-02 10:02:00'),
      (6, 'gelgit enerjisi', timestamp'2024-01-02 10:02:01'),
      (7, 'hiç sorulmamış', timestamp'2024-01-03') AS t(query_id, query, ts)""")
    answers = spark.createDataFrame(
        [(1, "wikipedia", 1, None, "offline"), (1, "duckduckgo", 2, None, "offline"),
         (2, "wikipedia", 1, page("never asked"), "payload"),
         (3, "wikipedia", 1, None, "error"), (3, "duckduckgo", 2, json.dumps(DDG), "payload"),
         (4, "wikipedia", 1, page("newer"), "payload"), (5, "wikipedia", 1, page("wind"), "payload"),
         (6, "wikipedia", 1, json.dumps({"query": {"pages": []}}), "payload")],
        "query_id int, provider string, priority int, payload string, outcome string")
    rows = chat.ingest_searches(queries, answers, "service").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.status, r.asked, r.from_cache, r["rank"]) for r in rows] == [
        (1, "offline", True, 0, None), (2, "offline", False, 0, None),
        *[(3, "ok", True, 0, k) for k in (1, 2, 3)], *[(4, "ok", False, 1, k) for k in (1, 2, 3)],
        (5, "ok", True, 0, 1), (6, "empty", True, 0, None), (7, "error", True, 0, None)]
    by_id = {r.query_id: r for r in rows}
    assert by_id[4].source_id == 3 and by_id[4].cached_us == by_id[3].cached_us
    assert by_id[4].source == "duckduckgo" and by_id[5].title == "wind"
    alone = chat.ingest_searches(queries, answers).filter("query_id = 2").first()
    assert alone.title == "never asked" and alone.asked
    nothing = chat.ingest_searches(queries.limit(0), answers.limit(0))
    assert nothing.count() == 0

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.operators import conversation as C
from themeloom.operators import linear
from themeloom.operators.dataset import Taxonomy
from themeloom.operators.features import Ngrams, stemmed
from themeloom.plans import build, chat, evaluate, train
from themeloom.sources import model_store
from themeloom.streaming.cache import stream_cache
from themeloom.streaming.scoring import stage_predictions, store_batches
from themeloom.streaming.themes import stream_scores

TAXONOMY = Taxonomy({c: K.CATEGORY_TOPICS[c] for c in ("optik", "futbol", "edebiyat")}, (), (),
                    ("Fizik", "Kitaplar", "Spor"))
LABELS = TAXONOMY.labels
WORDS = {
    "optik": "ışık mercek kırılma yansıma prizma lazer".split(),
    "futbol": "gol hakem penaltı forvet kaleci derbi".split(),
    "edebiyat": "roman şiir yazar öykü destan kafiye".split(),
    "diger0": "çorba tencere pilav baharat fırın sos".split(),
    "diger1": "keman piyano nota akort koro şarkı".split(),
    "diger2": "kumaş dikiş iğne kalıp etek düğme".split(),
    "diger4": "bahçe fidan toprak gübre saksı tohum".split(),
    "diger5": "otobüs durak bilet sefer peron yolcu".split(),
    "diger3": "oltacı balık ağ tekne liman yem".split(),
}
BLOCKS = (Ngrams("word", "word", 1, 2, 1, stemmed), Ngrams("char", "char", 3, 4, 2))


def suffix(i):
    return "".join(chr(97 + int(d)) for d in str(i + 100))


@pytest.fixture(scope="module")
def splits(spark):
    rows = []
    for category, words in WORDS.items():
        for i in range(24):
            a, b, c = (words[(i + k) % 6] for k in (0, 1, 3))
            rows.append((len(rows), category, f"{suffix(i)} {category}", f"{a} {b} {c} {suffix(i)}"))
    cards = spark.createDataFrame(rows, "pos long, category string, term string, definition string")
    out = build.build_splits(cards, TAXONOMY, "pos")
    ids = F.monotonically_increasing_id()
    return spark.createDataFrame(out.withColumn("doc_id", ids).collect(),
                                 out.withColumn("doc_id", ids).schema).cache()


@pytest.fixture(scope="module")
def training(splits):
    return train.train(splits, LABELS, BLOCKS, epochs=20, commit="0123456789abcdef")


def test_training(spark, training, tmp_path):
    m = training.model
    assert m.metadata["algorithm"] in ("softmax_regression", "multinomial_naive_bayes")
    assert m.metadata["dataset"]["version"] == "0123456789ab"
    assert m.min_confidence in K.CONFIDENCE_GRID and .05 < m.temperature < 10
    assert training.grid.count() == 15
    assert [e for e, _ in training.history] == list(range(1, len(training.history) + 1))
    assert max(training.scores.values()) > .3
    row = model_store.registry_row(m, "v").first()
    assert row.model_version == K.MODEL_VERSION and row.weights_sha256


def test_evaluation(splits, training):
    reports = evaluate.evaluate(training.model, splits, LABELS)
    assert reports["argmax"].first().accuracy > .8
    assert reports["per_class"].count() == 4 and reports["confusion"].count() == 16
    assert reports["ood_rejection"].first().n > 0
    assert 0 <= reports["ece"].first().ece <= 1
    for name in ("thresholded", "subtopic_accuracy", "status_counts", "short_inputs",
                 "ood_status_counts", "worst_categories", "external_recall"):
        reports[name].collect()


def test_chat(spark, training):
    rows = [(1, 0, "Roman ve şiir yazar."), (1, 1, "!!!"), (1, 2, "mercek prizma ışık kırılma"),
            (1, 3, "SIFIRLA"), (1, 4, "hakem penaltı gol"), (2, 0, "gol forvet kaleci"),
            (2, 1, "Çıkış"), (2, 2, " HELP ")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    out = chat.process_messages(training.model.with_decision(training.model.temperature, 0.0), messages,
                                min_weight=-100.0)
    quiet = chat.empty_messages(messages).collect()
    assert [(r.conv_id, r.turn, r.status, r.warnings) for r in quiet] == [
        (1, 1, "empty", ["no content"])]
    got = {r.message_id: r for r in out.collect()}
    assert set(got) == {"1:0", "1:2", "1:4", "2:0"}
    assert [got[m].message_index for m in ("1:0", "1:2", "1:4", "2:0")] == [1, 2, 1, 1]
    assert got["1:4"].session_no == 1 and got["1:4"].top_guess == "Spor"
    assert got["1:4"].query.startswith("futbol") and not got["1:4"].warnings
    assert {t.name for t in got["1:2"].topics} >= {"Kitaplar", "Fizik"}


def test_acceptance_tables(spark, training):
    texts = spark.createDataFrame([(1, "hakem penaltı gol"), (2, "roman şiir")],
                                  "id long, text string")
    p = linear.predict(training.model.with_decision(training.model.temperature, 0.0), texts, "id")
    expected = spark.createDataFrame([(1, "Spor", "Futbol"), (2, "Fizik", None)],
                                     "id long, expected_general string, expected_subtopic string")
    got = {r.id: (r.passed, r.expected) for r in evaluate.check_sentences(p, expected).collect()}
    assert got == {1: (True, "Spor > Futbol"), 2: (False, "Fizik")}
    turns = spark.createDataFrame(
        [("s", 1, "Spor", "spor", [("Futbol", .9)]), ("s", 2, "Fizik", "x", [])],
        "scenario string, message_index int, general string, phrase string, "
        "subtopics array<struct<name:string,score:double>>")
    wanted = spark.createDataFrame(
        [("s", 1, "Spor", "spor", "Futbol"), ("s", 2, "Fizik", None, None),
         ("t", 1, "Spor", None, None)],
        "scenario string, message_index int, expected_general string, expected_phrase string, "
        "expected_subtopic string")
    assert {r.scenario: r.passed for r in evaluate.check_conversations(turns, wanted).collect()
            } == {"s": True, "t": False}


def run_once(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_of_themes_survives_restart_and_late_turns(spark, tmp_path):
    schema = ("conv_id long, turn long, reset boolean, general_scores map<string,double>, "
              "joint_subtopic_scores map<string,map<string,double>>")
    first = [(1, 0, False, {"Spor": .8, "Diğer": .2}, {}), (2, 0, False, {"Tarih": 1.0}, {}),
             (1, 2, False, {"Spor": .5, "Tarih": .5}, {}), (1, 1, False, None, None)]
    second = [(1, 1, False, {"Kimya": 1.0}, {}), (1, 3, False, {"Tarih": 1.0}, {}),
              (2, 1, True, None, None), (2, 2, False, {"Spor": 1.0}, {})]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    general = [*K.GENERAL_TOPICS, K.OTHER_LABEL]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run_once(store_batches(stream_scores(stream, general, idle_ms=None), out,
                               str(tmp_path / "state")))
    stored = spark.read.parquet(out)
    assert [(r.conv_id, r.turn) for r in stored.filter("late").collect()] == [(1, 1)]
    themed = C.themes(stored.filter("not late"))
    got = {(r.conv_id, r.turn): r for r in themed.collect()}
    assert set(got) == {(1, 0), (1, 2), (1, 3), (2, 0), (2, 2)}
    assert (got[2, 2].session_no, got[2, 2].message_index, got[2, 2].phrase) == (1, 1, "spor")
    assert got[1, 3].message_index == 3
    scores = {s.name: s.score for s in got[1, 3].scores}
    assert scores["Spor"] == pytest.approx((.8 * .7 + .5) * .7)
    assert scores["Tarih"] == pytest.approx(.5 * .7 + 1.0) and scores["Kimya"] == 0


def test_stream_cache_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ("(1, 'q', timestamp'2024-01-01 00:00:00')",
                 "(2, 'q', timestamp'2024-01-02 00:00:00'), (3, 'q', timestamp'2024-01-02 00:00:01')"):
        batch = spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, k, ts)")
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        run_once(store_batches(stream_cache(stream, "k", "ts", "id"), out,
                               str(tmp_path / "state")))
    got = {r.id: r.hit for r in spark.read.parquet(out).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_stream_scoring(spark, training, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    messages = spark.createDataFrame([("a", "hakem penaltı gol"), ("b", "...")],
                                     "message_id string, text string")
    messages.write.parquet(source)
    stream = spark.readStream.schema(messages.schema).parquet(source)
    run_once(stage_predictions(stream, training.model.with_decision(training.model.temperature, 0.0), out,
                               str(tmp_path / "state")))
    got = {r.message_id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {"a": "ok", "b": "empty"}

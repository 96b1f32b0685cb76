from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from themeloom.functions import decisions as D
from themeloom.operators import (
    batches, calibration, features, keywords, linear, metrics, softmax, splitting,
)
from themeloom.operators.features import Ngrams
from themeloom.sources import model_store

TEXTS = ["gemi açık deniz", "tren uzun ray", "gemi derin liman", "tren durdu"]
LABELS = ["gemi", "tren", "gemi", "tren"]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(
        [(i, t, c) for i, (t, c) in enumerate(zip(TEXTS, LABELS, strict=True))],
        "doc_id long, text string, label string").cache()


def plain(high=1, min_df=1):
    return Ngrams("word", "word", 1, high, min_df)


def test_idf_and_norm(tiny):
    fitted = features.fit(tiny, [plain()])
    idf = {r.term: r.idf for r in fitted.vocabulary.collect()}
    assert idf["gemi"] == pytest.approx(math.log(5 / 3) + 1)
    norms = fitted.transform(tiny).groupBy("doc_id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert [r.n for r in norms] == pytest.approx([1.0] * 4)


def test_unknown_terms_leave_the_norm(spark, tiny):
    fitted = features.fit(tiny, [plain()])
    new = spark.createDataFrame([(9, "gemi görülmemiş sözcük")], "doc_id long, text string")
    rows = fitted.transform(new).collect()
    assert [(r.term, r.weight) for r in rows] == [("gemi", 1.0)]


def test_char_counts_by_distinct_word(spark):
    df = spark.createDataFrame([(1, "aba aba ab")], "doc_id long, text string")
    got = {r.term: r.tf for r in features.term_counts(
        df, Ngrams("char", "char", 2, 3)).collect()}
    expected = {}
    for w in ("aba", "aba", "ab"):
        p = f" {w} "
        for n in (2, 3):
            for i in range(len(p) - n + 1):
                expected[p[i:i + n]] = expected.get(p[i:i + n], 0) + 1
    assert got == expected


def test_counts_inside_the_row(spark):
    df = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, None), (4, "a")],
                               "doc_id long, text string")
    block = Ngrams("word", "word", 1, 2, 1, lambda c: c)
    wide = df.withColumn("text", F.regexp_replace("text", "([abc])", "$1$1"))
    got = {(r.doc_id, r.term): r.tf for r in features.term_counts(wide, block).collect()}
    assert got == {(1, "aa"): 2, (1, "bb"): 3, (1, "cc"): 1, (1, "bb aa"): 1, (1, "aa bb"): 2,
                   (1, "bb cc"): 1, (1, "cc aa"): 1, (4, "aa"): 1}


def reference_bayes(alpha, prior):
    """Dense multinomial naive Bayes on the same TF-IDF values, in plain Python."""
    docs = [t.split() for t in TEXTS]
    vocab = sorted({w for d in docs for w in d})
    df = {w: sum(w in d for d in docs) for w in vocab}
    rows = []
    for d in docs:
        x = {w: (1 + math.log(d.count(w))) * (math.log(5 / (1 + df[w])) + 1) for w in set(d)}
        n = math.sqrt(sum(v * v for v in x.values()))
        rows.append({w: v / n for w, v in x.items()})
    classes = sorted(set(LABELS))
    out = []
    for r in rows:
        scores = []
        for c in classes:
            total = {w: sum(q.get(w, 0.0) for q, y in zip(rows, LABELS, strict=True) if y == c)
                     for w in vocab}
            z = sum(total.values()) + alpha * len(vocab)
            p = 0.5 if prior else LABELS.count(c) / len(LABELS)
            scores.append(math.log(p) + sum(v * math.log((total[w] + alpha) / z)
                                            for w, v in r.items()))
        out.append(scores)
    return out


@pytest.mark.parametrize("alpha, uniform", [(1.0, True), (0.001, False)])
def test_naive_bayes(tiny, alpha, uniform):
    model = linear.train_naive_bayes(tiny, [plain()], alpha, uniform)
    got = [r.logits for r in model.logits(tiny).orderBy("doc_id").collect()]
    for a, b in zip(got, reference_bayes(alpha, uniform), strict=True):
        assert a == pytest.approx(b, rel=1e-9)
    labels = [r.argmax for r in linear.decisions(model, tiny).orderBy("doc_id").collect()]
    assert labels == LABELS


def test_texts_without_known_terms_score_the_bias(spark, tiny):
    model = linear.train_naive_bayes(tiny, [plain()])
    new = spark.createDataFrame([(1, "yok"), (2, "")], "doc_id long, text string")
    assert [r.logits for r in model.logits(new).collect()] == [model.bias, model.bias]


def test_softmax_separates_and_round_trips(spark, tiny, tmp_path):
    model = softmax.train_softmax(tiny, [plain()], 20)
    assert [r.argmax for r in linear.decisions(model, tiny).orderBy("doc_id").collect()] == LABELS
    p = model.probabilities(tiny).select(F.aggregate("probabilities", F.lit(0.0),
                                                     lambda a, x: a + x).alias("s")).collect()
    assert [r.s for r in p] == pytest.approx([1.0] * 4)
    model = model.with_decision(1.3, 0.4)
    model.metadata = {"model_version": "test"}
    folder = str(tmp_path / "model")
    model_store.save_model(model, folder)
    loaded = model_store.load_model(spark, folder, model.blocks)
    assert loaded.metadata == {"model_version": "test"} and loaded.temperature == 1.3
    a = [r.probabilities for r in model.probabilities(tiny).orderBy("doc_id").collect()]
    b = [r.probabilities for r in loaded.probabilities(tiny).orderBy("doc_id").collect()]
    assert [x for r in a for x in r] == pytest.approx([x for r in b for x in r])
    assert model_store.fingerprint(model) == model_store.fingerprint(loaded)
    with pytest.raises(model_store.ModelStoreError):
        model_store.load_model(spark, str(tmp_path / "none"), model.blocks)
    with pytest.raises(model_store.ModelStoreError):
        model_store.load_model(spark, folder, [plain(2)])
    loaded.terms.limit(3).select("analyzer", "term", "w").write.mode("overwrite").parquet(
        f"{folder}/weights2")
    spark.read.parquet(f"{folder}/weights2").write.mode("overwrite").parquet(f"{folder}/weights")
    with pytest.raises(model_store.ModelStoreError):
        model_store.load_model(spark, folder, model.blocks)


def test_every_labelled_row_trains(spark, tiny):
    more = tiny.unionByName(spark.createDataFrame([(8, "", "gemi"), (9, "!!", "tren")], tiny.schema))
    trainer = softmax.SoftmaxTrainer(more, features.fit(tiny, [plain()]))
    assert trainer.rows.count() == 6
    assert trainer.rows.agg(F.sum("_share")).first()[0] == pytest.approx(1.0)


def test_a_step_follows_the_gradient(spark, tiny):
    fitted = features.fit(tiny, [plain()])
    x = {(r.doc_id, r.term): r.weight for r in fitted.transform(tiny).collect()}
    steps = [m for _, m in softmax.SoftmaxTrainer(tiny, fitted, l2=0.5).steps(2)]
    terms = sorted({t for _, t in x})
    w, v = {(t, c): 0.0 for t in terms for c in range(2)}, {}
    b, bv = [0.0, 0.0], [0.0, 0.0]
    for model in steps:
        g, gb = dict.fromkeys(w, 0.0), [0.0, 0.0]
        for i, label in enumerate(LABELS):
            z = [b[c] + sum(x.get((i, t), 0.0) * w[t, c] for t in terms) for c in range(2)]
            e = [math.exp(s - max(z)) for s in z]
            for c in range(2):
                r = (e[c] / sum(e) - (model.classes[c] == label)) / 4
                gb[c] += r
                for t in terms:
                    g[t, c] += x.get((i, t), 0.0) * r
        for c in range(2):
            bv[c] = softmax.MOMENTUM * bv[c] - softmax.RATE * gb[c]
            b[c] += bv[c]
        for k in w:
            v[k] = softmax.MOMENTUM * v.get(k, 0.0) - softmax.RATE * (g[k] + 0.5 * w[k])
            w[k] += v[k]
        got = {r.term: r.w for r in model.terms.collect()}
        assert model.bias == pytest.approx(b)
        assert all(got[t] == pytest.approx([w[t, 0], w[t, 1]]) for t in terms)


def test_batches_of_adam(spark, tiny, monkeypatch):
    fitted = features.fit(tiny, [plain()])
    results = []
    for merge in (1, 16):  # merging the tables of steps early changes nothing
        monkeypatch.setattr(batches, "MERGE", merge)
        trainer = batches.BatchTrainer(tiny, fitted, batch_size=2)
        assert trainer.batches == 2
        (_, model), = trainer.steps(1)
        results.append({r.term: list(r.w) for r in model.terms.collect()})
    assert results[0] == results[1]
    assert {len(w) for w in results[0].values()} == {2}
    dealt = [r.b for r in spark.range(1000).select(
        batches.batch_of(F.col("id"), 1, 4).alias("b")).collect()]
    assert set(dealt) == {0, 1, 2, 3} and all(200 < dealt.count(b) < 300 for b in range(4))
    model = softmax.train_softmax(tiny, [plain()], 3, trainer=batches.BatchTrainer, rate=0.1)
    assert [r.argmax for r in linear.decisions(model, tiny).orderBy("doc_id").collect()] == LABELS


def test_early_stop():
    values = {1: .1, 2: .5, 3: .4, 4: .4, 5: .9}
    models = ((i, f"m{i}") for i in values)
    assert softmax.early_stop(models, lambda m: values[int(m[1])], 2) == (
        2, "m2", [(1, .1), (2, .5), (3, .4), (4, .4)])


def test_keywords(spark, tiny):
    model = linear.train_naive_bayes(tiny, [plain()])
    asked = spark.createDataFrame([(1, "gemi tren açık gemi", "gemi"), (2, "gemi", None)],
                                  "doc_id long, text string, general string")
    got = {r.doc_id: r.keywords for r in keywords.topic_keywords(
        model, asked, min_weight=-3.0).collect()}
    assert got == {1: ["gemi", "açık"], 2: []}


def test_predict_record(spark, tiny):
    model = linear.train_naive_bayes(tiny, [plain()]).with_decision(1.0, 0.6)
    rows = spark.createDataFrame([(1, "!!! ..."), (2, "gemi" + " açık" * 2000)],
                                 "doc_id long, text string")
    a, b = linear.predict(model, rows).orderBy("doc_id").collect()
    assert (a.status, a.general, a.confidence, a.general_scores) == ("empty", None, 0.0, None)
    assert b.status == "ok" and b.general == "gemi" and b.truncated
    assert sum(b.general_scores.values()) == pytest.approx(1.0, abs=1e-3)


# ------------------------------------------------------------------------------ decisions

CLASSES = ["Diğer", "Fizik > Kuantum Mekaniği", "Fizik > Optik",
           "Teknoloji > Kuantum Bilgisayarlar"]


def test_marginals(spark):
    df = spark.createDataFrame([([.1, .3, .2, .4],)], "p array<double>")
    joint = D.joint_scores(F.col("p"), CLASSES)
    row = df.select(D.marginals(F.col("p"), CLASSES).alias("g"),
                    D.conditionals(joint, F.lit("Fizik"), F.lit(0.5)).alias("c")).first()
    assert {x.name: x.score for x in row.g} == pytest.approx(
        {"Diğer": .1, "Fizik": .5, "Teknoloji": .4})
    assert {x.name: x.score for x in row.c} == pytest.approx(
        {"Kuantum Mekaniği": .6, "Optik": .4})


@pytest.mark.parametrize("top, confidence, expected", [
    ("Fizik", .9, ("ok", "Fizik")), ("Fizik", .75, ("ok", "Fizik")),
    ("Fizik", .6, ("uncertain", "Belirsiz")), ("Diğer", .7, ("out_of_scope", "Diğer"))])
def test_decide(spark, top, confidence, expected):
    df = spark.createDataFrame([(top, confidence)], "t string, c double")
    assert tuple(df.select(D.decide(F.col("t"), F.col("c"), .75).alias("d")).first().d) == expected


@pytest.mark.parametrize("low, limit, names", [(.5, 3, ["A"]), (.1, 3, ["A", "B", "C"]),
                                               (.01, 2, ["A", "B"])])
def test_select_subtopics(spark, low, limit, names):
    scores = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))
                       for n, s in (("D", .05), ("B", .3), ("A", .5), ("C", .15))])
    row = spark.range(1).select(D.select_subtopics(scores, low, limit).alias("s")).first()
    assert [x.name for x in row.s] == names


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "z array<double>")
    assert df.select(D.softmax(F.col("z"))).first()[0] == pytest.approx([.5, .5, 0.0])


# ------------------------------------------------------------------------------ metrics

def pairs(spark, rows):
    return metrics.pair_counts(spark.createDataFrame(rows, "true string, pred string"))


def test_report(spark):
    counts = pairs(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")])
    row = metrics.summary(counts, ["a", "b"], digits=12).first()
    assert row.accuracy == .75 and row.macro_f1 == pytest.approx((2 / 3 + .8) / 2)
    wide = metrics.summary(counts, ["a", "b", "c"], digits=12).first()
    assert wide.macro_f1 == pytest.approx((2 / 3 + .8) / 3)
    outside = pairs(spark, [("a", "a"), ("x", "x"), ("a", "x")])
    row = metrics.summary(outside, ["a"], digits=12).first()
    assert (row.n, row.accuracy, row.macro_f1) == (3, pytest.approx(2 / 3), 1.0)
    cells = {(r["true"], r["pred"]): r["n"] for r in metrics.confusion(counts, ["a", "b"]).collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}


def test_calibration_error(spark):
    df = spark.createDataFrame([(.9, False)] * 2, "confidence double, correct boolean")
    assert metrics.calibration_error(df).first().ece == pytest.approx(.9)
    df = spark.createDataFrame([(0.0, True), (1.0, True)], "confidence double, correct boolean")
    assert metrics.calibration_error(df).first().ece == pytest.approx(0.0)


def test_exact_quantiles(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.normal(size=997)] + [0.25] * 500
    df = spark.createDataFrame([("a" if i % 2 else "b", v) for i, v in enumerate(values)],
                               "g string, v double")
    got = {(r.g, r.probability): r.value for r in metrics.exact_quantiles(
        df, "v", [0.0, .5, .95, 1.0], ["g"], 16).collect()}
    for g in "ab":
        mine = [v for i, v in enumerate(values) if (i % 2 == 1) == (g == "a")]
        for p in (0.0, .5, .95, 1.0):
            assert got[g, p] == pytest.approx(float(np.percentile(mine, p * 100)))


def test_temperature_finds_the_minimum(spark):
    rows = [([2.0, 0.0], 0), ([2.0, 0.0], 0), ([2.0, 0.0], 1), ([0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "logits array<double>, target int")

    def loss(t):
        return sum(-math.log(math.exp(z[y] / t) / sum(math.exp(v / t) for v in z) + 1e-12)
                   for z, y in rows) / len(rows)
    best = calibration.fit_temperature(df, tolerance=1e-6)
    grid = [math.exp(math.log(.05) + i * math.log(200) / 20000) for i in range(20001)]
    assert best == pytest.approx(min(grid, key=loss), rel=1e-3)


# ------------------------------------------------------------------------------ splits

def test_grouped_split(spark):
    rows = [(i, "a" if i < 40 else "b", f"g{i // 2}") for i in range(80)]
    df = spark.createDataFrame(rows, "row_id int, label string, group string")
    got = splitting.grouped_split(df, .25, 1).collect()
    held = [r for r in got if r.held]
    assert len(got) == 80
    for label in "ab":
        assert 8 <= sum(r.label == label for r in held) <= 12
    assert not {r.group for r in held} & {r.group for r in got if not r.held}
    with pytest.raises(ValueError):
        splitting.grouped_split(df, 1.0, 1)


def test_term_lists_hold_the_counts_without_an_exchange(spark):
    from themeloom.catalog import texts as queries
    rows = [(1, "bir iki iki bir iki"), (2, ""), (3, None), (4, "x"), (5, "üç " * 40 + "dört 𝒳yz"),
            (6, "iki")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for block in (features.word_block(()), features.word_block(("bir",), 1),
                  features.char_block(), features.Ngrams("char", "char", 1, 3)):
        each = sorted(map(tuple, features.term_counts(docs, block).collect()))
        lists = features.term_lists(docs, block)
        assert lists.count() == len(rows)
        assert sorted((r.doc_id, t, n) for r in lists.collect()
                      for t, n in zip(r.terms, r.tfs, strict=True)) == each
        top = {}
        for d, t, n in each:
            known = top.get(d, (0, 0, 0, ""))
            best = min((-known[2], known[3]), (-n, t))
            top[d] = (known[0] + 1, known[1] + n, -best[0], best[1])
        done = queries._per_doc(lists)
        assert {r.doc_id: tuple(r)[1:] for r in done.collect()} == top
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_words_are_handed_on_in_parts():
    import pyarrow as pa

    from themeloom.functions import wordgrams
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["aa bb", None, "cc aa cc"])],
                                       names=["k", "t"])
    whole = list(wordgrams.counted_batches(iter([batch]), ["k"], "t", 1, 2, ["bb"]))
    before, wordgrams.CHUNK = wordgrams.CHUNK, 1
    try:
        parts = list(wordgrams.counted_batches(iter([batch]), ["k"], "t", 1, 2, ["bb"]))
        lists = list(wordgrams.listed_batches(iter([batch]), ["k"], "t", 1, 2, ["bb"]))
    finally:
        wordgrams.CHUNK = before
    rows = [tuple(r.values()) for b in parts for r in b.to_pylist()]
    assert len(parts) > 1 and rows == [tuple(r.values()) for b in whole for r in b.to_pylist()]
    assert rows == [(7, "aa", 1), (9, "cc", 2), (9, "aa", 1), (9, "cc aa", 1), (9, "aa cc", 1)]
    assert [r["k"] for b in lists for r in b.to_pylist()] == [7, 8, 9]


def test_groups_name_each_term_once(spark, tiny, monkeypatch):
    """Documents of several groups: a term's numbers add up to its df, and sums to the weights'."""
    monkeypatch.setattr(features, "LEAST_GROUP", 8)
    block = plain()
    counts = features.count_terms(tiny, [block], keep=["label"])
    counted = counts[block.name]
    assert counted.docs.select("_group").distinct().count() > 1
    rows = counted.terms.collect()
    assert len({(r["_group"], r.term) for r in rows}) == len(rows)
    plainly = {r.term: r.df for r in features.document_frequency(
        features.term_counts(tiny, block)).collect()}
    fitted = features.fit(tiny, [block], counts=counts)
    assert {r.term: r.df for r in fitted.vocabulary.collect()} == plainly

    def added(vectors):
        out = {}
        for r in vectors.collect():
            out[r.label, r.term] = out.get((r.label, r.term), 0.0) + r.weight
        return out

    whole = added(features.fit(tiny, [block]).transform(tiny, keep=["label"]))
    summed = added(fitted.sums(tiny, "label", counts=counts))
    assert whole.keys() == summed.keys()
    assert all(abs(whole[k] - summed[k]) < 1e-12 for k in whole)


def test_corpus_weights_write_texts_alone(spark, sf):
    """The same weights as by a fitted vocabulary, of which nothing is written."""
    import math
    from pathlib import Path

    from themeloom.operators import features
    from themeloom.session import recorded
    rows = [(1, "ab abc abcd ab"), (2, "abc xyz"), (3, ""), (4, None), (5, "q"), (6, "ab ab xyz"),
            (1, "second text of id one"), *((10 + i, f"word{i} ab text") for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for block in (features.word_block(()), features.char_block(), features.char_block(1, 3, 1)):
        expected = {}
        for r in features.fit(docs, [block]).transform(docs).collect():
            expected.setdefault(r.doc_id, []).append(r.weight)
        got = {}
        for r in features.fit_weights(docs, [block]).collect():
            got.setdefault(r.doc_id, []).extend(r.weights)
        assert got.keys() == expected.keys()
        assert all(math.isclose(a, b, abs_tol=1e-12) for k in got for a, b in zip(
            sorted(got[k]), sorted(expected[k]), strict=True))
    from __spark_entry__ import queries
    with recorded() as tables:
        assert queries()["tfidf_combined"](spark, sf).count() > 0
    written = sum(f.stat().st_size for t in tables
                  for f in Path(t.removeprefix("file:")).rglob("*.parquet"))
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    assert written < 2.5 * texts


def test_hashed_groups_train_the_same_model(spark, monkeypatch):
    """Model, scores and totals out of hashed groups are those of the tables of terms, and no table
    of terms is exchanged: terms travel as lists of hashes, those of one group not at all."""
    monkeypatch.setattr(features, "LEAST_GROUP", 64)
    docs = spark.createDataFrame(
        [(i, f"common words {'often' if i % 2 else 'seldom'} seen w{i}x w{i // 2}y again w{i}x",
          "abc"[i % 3]) for i in range(40)] + [(40, None, "a"), (41, "", "b"), (41, "common words", "b")],
        "doc_id long, text string, label string")
    block = features.word_block(())
    plain = features.count_terms(docs, [block], keep=["label"])
    hashed = features.hash_terms(docs, [block], keep=["label"])
    assert hashed["word"].docs.select("_group").distinct().count() > 4
    lists = hashed["word"].shared.filter("_group >= 0").selectExpr("explode(terms) as t")
    terms = {r.term: r for r in linear.train_naive_bayes(docs, [block], counts=plain).terms.collect()}
    assert 0 < lists.distinct().count() < len(terms) == hashed["word"].n_terms
    models = [linear.train_naive_bayes(docs, [block], counts=c) for c in (plain, hashed)]
    got = models[1].terms.collect()
    assert len(got) == len(terms) and {r.term for r in got} == set(terms)
    for r in got:
        assert r.df == terms[r.term].df and r.w == pytest.approx(terms[r.term].w, abs=1e-9)
    scores = [sorted((r.doc_id, tuple(round(z, 8) for z in r.logits)) for r in m.logits(
        docs, counts=c).collect()) for m, c in zip(models, (plain, hashed), strict=True)]
    assert scores[0] == scores[1] and len(scores[0]) == 43
    totals = {(r.term, r.label): r.total for r in linear.term_totals(
        hashed["word"], ["a", "b", "c"]).collect()}
    fitted = features.fit(docs, [block], counts=plain)
    want = {(r.term, "abc"[i]): t for r in linear.class_totals(
        fitted.sums(docs, "label", counts=plain), ["a", "b", "c"]).collect()
        for i, t in enumerate(r.totals) if t > 0}
    assert totals == pytest.approx(want, abs=1e-9)

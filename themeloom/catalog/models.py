"""Registered queries: models, decisions, metrics and calibration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.catalog.common import (
    JOINT_CLASSES, LABELS, OTHER, STOPWORDS, cards, idf, in_list, labelled, nb_ctes, nb_scores, norm,
    query, table, texts, tfidf, word_counts,
)
from themeloom.functions import decisions as D
from themeloom.operators import batches, calibration, features, linear, metrics, softmax
from themeloom.operators.features import word_block
from themeloom.plans import build, evaluate
from themeloom.session import materialize, run_folder
from themeloom.sources import model_store
from themeloom.streaming.scoring import stage_predictions

CLASSES = JOINT_CLASSES
MIN_CONFIDENCE = 0.6


def _bayes(spark, sf, high=1, **options):
    return linear.train_naive_bayes(labelled(spark, sf), [word_block((), high)], **options)


# ------------------------------------------------------------------------------------ training

@query(f"""WITH {nb_ctes(2)} SELECT label, term, round(t, 6) AS total FROM tot WHERE t > 0""")
def nb_class_totals(spark, sf):
    """Feature mass of every class and term (words and word pairs)."""
    docs = labelled(spark, sf)
    counts = features.hash_terms(docs, [word_block(())], keep=["label"])
    totals = [linear.term_totals(c, CLASSES) for c in counts.values()]
    return totals[0].select("label", "term", F.round("total", 6).alias("total"))


_DECIDED = f"""
  qg AS (SELECT ID, general, sum(p) AS p FROM qp GROUP BY ALL),
  qt AS (SELECT ID, arg_min(general, {{'a': -p, 'b': general}}) AS argmax, max(p) AS confidence
         FROM qg GROUP BY ID),
  qd AS (SELECT *, CASE WHEN argmax = '{OTHER}' THEN 'out_of_scope'
           WHEN confidence < {MIN_CONFIDENCE} THEN 'uncertain' ELSE 'ok' END AS status FROM qt)"""


def _decided(id_col: str) -> str:
    return _DECIDED.replace("ID", id_col)


_PREDICTED = f"""WITH {nb_ctes(2)}, {nb_scores('documents', 'doc_id', 2)}, {_decided('doc_id')},
  qb AS (SELECT doc_id, general, arg_min(subtopic, {{'a': -p, 'b': subtopic}}) AS subtopic
         FROM qp WHERE subtopic IS NOT NULL GROUP BY ALL)
  SELECT qd.doc_id, argmax, round(confidence, 4) AS confidence, status,
    CASE WHEN status = 'ok' THEN argmax ELSE '{OTHER}' END AS label, qb.subtopic
  FROM qd LEFT JOIN qb ON qb.doc_id = qd.doc_id AND qb.general = qd.argmax"""


@query(_PREDICTED)
def nb_predict(spark, sf):
    """Train on all documents, decide every whole document."""
    docs = labelled(spark, sf)
    block = word_block(())
    counts = features.hash_terms(docs, [block], keep=["label"])
    model = linear.train_naive_bayes(docs, [block], counts=counts).with_decision(
        1.0, MIN_CONFIDENCE)
    out = linear.decisions(model, docs, other=OTHER, counts=counts)
    return out.withColumn("confidence", F.round("confidence", 4))


@query(_PREDICTED)
def stored_model(spark, sf):
    """The same by a model that was saved, loaded and checked; its fingerprint has to survive."""
    docs = labelled(spark, sf)
    blocks = [word_block(())]
    counts = features.count_terms(docs, blocks, keep=["label"])
    model = linear.train_naive_bayes(docs, blocks, counts=counts).with_decision(
        1.0, MIN_CONFIDENCE)
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    model_store.save_model(model, folder)
    loaded = model_store.load_model(spark, folder, blocks)
    if model_store.fingerprint(loaded) != model_store.fingerprint(model):
        raise ValueError("the stored model differs")
    out = linear.decisions(loaded, docs, other=OTHER, counts=counts)
    return out.withColumn("confidence", F.round("confidence", 4))


@query(f"""WITH {nb_ctes(1, 1.0)}, {nb_scores('benchmark', 'item_id', 1, 1.0)},
  cp AS (SELECT label, ln(count(*) / (SELECT count(*) FROM lab)) AS prior FROM lab GROUP BY label)
  SELECT item_id, arg_min(qs.label, {{'a': -(z + prior), 'b': qs.label}}) AS label,
    round(max(z + prior) - ln(1.0 / (SELECT count(*) FROM cls)), 6) AS score
  FROM qs JOIN cp ON cp.label = qs.label GROUP BY item_id""")
def nb_empirical_prior(spark, sf):
    """Class prior from the data and full Laplace smoothing."""
    model = _bayes(spark, sf, alpha=1.0, uniform_prior=False)
    z = model.logits(table(spark, sf, "benchmark"), "item_id")
    best = F.array_max("logits")
    names = F.array(*[F.lit(c) for c in model.classes])
    return z.select("item_id", F.element_at(names, F.array_position("logits", best).cast("int"))
                    .alias("label"), F.round(best, 6).alias("score"))


@query(f"""SELECT label, n, round((SELECT count(*) FROM documents) / (k * n), 10) AS weight FROM
  (SELECT label, count(*) AS n, count(*) OVER () AS k FROM
    (SELECT CASE WHEN lang = 'es' THEN 'other' ELSE lang || ' > ' || CASE WHEN
       substring(source, 4, 2)::INT < 10 THEN 'a' ELSE 'b' END END AS label FROM documents)
   GROUP BY label)""")
def balanced_weights(spark, sf):
    return softmax.class_weights(labelled(spark, sf)).select(
        "label", "n", F.round("weight", 10).alias("weight"))


def _language_docs(spark, sf):
    docs = texts(spark, sf, "documents")
    return docs.select("doc_id", "text", F.col("lang").alias("label"))


_PLAIN = features.Ngrams("word", "word", 1, 1, 2, features.stemmed)


def _softmax_ctes(train: str, steps: int) -> str:
    """CTEs sm, sv, sx and, for every step i, w<i> and b<i>: gradient descent with momentum."""
    ctes = f"""
  sm AS (SELECT doc_id, text, lang AS label FROM documents WHERE {train}),
  sc AS ({word_counts('sm', 'doc_id', 1)}),
  sv AS (SELECT *, {idf('(SELECT count(*) FROM sm)')} AS idf FROM
         (SELECT term, count(*) AS df FROM sc GROUP BY term HAVING count(*) >= 2)),
  sx AS MATERIALIZED ({tfidf('sc', 'sv', 'doc_id')}),
  sk AS (SELECT label, count(*) AS n FROM sm GROUP BY label),
  sr AS (SELECT doc_id, sm.label AS truth, 1.0 / ((SELECT count(*) FROM sk) * n)::DOUBLE AS share
         FROM sm JOIN sk ON sk.label = sm.label),
  w0 AS (SELECT term, label, 0::DOUBLE AS w, 0::DOUBLE AS v FROM sv CROSS JOIN sk),
  b0 AS (SELECT label, 0::DOUBLE AS b, 0::DOUBLE AS v FROM sk)"""
    for i in range(1, steps + 1):
        j = i - 1
        ctes += f""",
  z{i} AS (SELECT sr.*, b.label, b.b + coalesce(s, 0) AS z FROM sr CROSS JOIN b{j} b LEFT JOIN
    (SELECT doc_id, label, sum(weight * w) AS s FROM sx JOIN w{j} USING (term) GROUP BY ALL) q
    ON q.doc_id = sr.doc_id AND q.label = b.label),
  r{i} AS MATERIALIZED (SELECT doc_id, label, share * (e / sum(e) OVER (PARTITION BY doc_id)
      - (label = truth)::INT) AS r
    FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM z{i})),
  b{i} AS MATERIALIZED (SELECT label, b + m AS b, m AS v FROM (SELECT b.*,
      {softmax.MOMENTUM} * v - {softmax.RATE} * g AS m FROM b{j} b JOIN
      (SELECT label, sum(r) AS g FROM r{i} GROUP BY label) USING (label))),
  w{i} AS MATERIALIZED (SELECT term, label, w + m AS w, m AS v FROM (SELECT w.*,
      {softmax.MOMENTUM} * v - {softmax.RATE} * (coalesce(g, 0) + {K.SOFTMAX_L2} * w) AS m
    FROM w{j} w LEFT JOIN (SELECT term, label, sum(weight * r) AS g FROM sx JOIN r{i}
      USING (doc_id) GROUP BY ALL) USING (term, label)))"""
    return ctes


def _softmax_scores(out: str, rows: str, vectors: str, step: int) -> str:
    """CTE ``out`` (doc_id, label, p) of documents under the weights of a step."""
    return f"""
  {out} AS (SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM
    (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM
      (SELECT d.doc_id, b.label, b.b + coalesce(s, 0) AS z FROM {rows} d CROSS JOIN b{step} b
       LEFT JOIN (SELECT doc_id, label, sum(weight * w) AS s FROM {vectors} JOIN w{step}
         USING (term) GROUP BY ALL) q ON q.doc_id = d.doc_id AND q.label = b.label)))"""


@query(f"""WITH {_softmax_ctes('true', 1)} SELECT term, label, round(w, 10) + 0.0 AS w FROM w1
  WHERE abs(w) >= 1e-9 UNION ALL SELECT '', label, round(b, 10) + 0.0 FROM b1""")
def softmax_step(spark, sf):
    """Weights and bias after one step from zero."""
    model = softmax.train_softmax(_language_docs(spark, sf), [_PLAIN], 1)
    names = F.array(*[F.lit(c) for c in model.classes])
    each = model.terms.select("term", F.posexplode("w").alias("i", "w")).filter(
        F.abs("w") >= 1e-9).select("term", F.get(names, F.col("i")).alias("label"), "w")
    bias = table(spark, sf, "documents").agg(F.count(F.lit(1))).select(
        F.lit("").alias("term"), F.explode(F.arrays_zip(
            names.alias("label"), F.array(*[F.lit(b) for b in model.bias]).alias("w"))).alias("e"))
    return each.unionByName(bias.select("term", "e.label", "e.w")).withColumn(
        "w", F.round("w", 10) + F.lit(0.0))


@query(f"""WITH {_softmax_ctes('true', 5)}, {_softmax_scores('sp', 'sm', 'sx', 5)}
  SELECT doc_id, arg_min(label, {{'a': -p, 'b': label}}) AS argmax, round(max(p), 6) AS confidence
  FROM sp GROUP BY doc_id""")
def softmax_language(spark, sf):
    """Class-weighted softmax regression on stemmed words; decisions on all documents."""
    docs = _language_docs(spark, sf)
    counts = features.count_terms(docs, [_PLAIN], keep=["label"])
    model = softmax.train_softmax(docs, [_PLAIN], 5, counts=counts)
    out = linear.decisions(model, docs, other="es", counts=counts)
    return out.select("doc_id", "argmax", F.round("confidence", 6).alias("confidence"))


_BATCHES, _EPOCHS = 2, 2


def _adam_ctes() -> str:
    """CTEs aw<i>, ab<i> after each step: Adam over seeded batches, untouched terms as they were."""
    first, second, rate = batches.FIRST, batches.SECOND, batches.ADAM_RATE

    def moments(step: int, g: str) -> str:
        m, v = f"({first} * m + {1 - first} * ({g}))", f"({second} * v + {1 - second} * ({g}) ** 2)"
        return (f"- {rate} * ({m} / {1 - first ** step}) / (sqrt({v} / {1 - second ** step}) + "
                f"{batches.EPSILON}) AS change, {m} AS m1, {v} AS v1")

    ctes = """
  aw0 AS (SELECT term, label, 0::DOUBLE AS w, 0::DOUBLE AS m, 0::DOUBLE AS v FROM sv CROSS JOIN sk),
  ab0 AS (SELECT label, 0::DOUBLE AS b, 0::DOUBLE AS m, 0::DOUBLE AS v FROM sk)"""
    for i in range(1, _BATCHES * _EPOCHS + 1):
        j, epoch, batch = i - 1, (i - 1) // _BATCHES + 1, (i - 1) % _BATCHES
        ctes += f""",
  ar{i} AS MATERIALIZED (SELECT * FROM sr WHERE ('0x' || substr(md5('{batches.SEED}|{epoch}|' ||
    doc_id), 1, 8))::BIGINT % {_BATCHES} = {batch}),
  ae{i} AS MATERIALIZED (SELECT doc_id, label, share / (SELECT sum(share) FROM ar{i}) *
      (e / sum(e) OVER (PARTITION BY doc_id) - (label = truth)::INT) AS r
    FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM
      (SELECT d.*, b.label, b.b + coalesce(s, 0) AS z FROM ar{i} d CROSS JOIN ab{j} b LEFT JOIN
        (SELECT doc_id, label, sum(weight * w) AS s FROM sx JOIN aw{j} USING (term) GROUP BY ALL) q
        ON q.doc_id = d.doc_id AND q.label = b.label))),
  ab{i} AS MATERIALIZED (SELECT label, b + change AS b, m1 AS m, v1 AS v FROM
    (SELECT *, {moments(i, 'g')} FROM ab{j} JOIN (SELECT label, sum(r) AS g FROM ae{i}
      GROUP BY label) USING (label))),
  aw{i} AS MATERIALIZED (SELECT term, label, CASE WHEN g IS NULL THEN w ELSE w + change END AS w,
      CASE WHEN g IS NULL THEN m ELSE m1 END AS m, CASE WHEN g IS NULL THEN v ELSE v1 END AS v
    FROM (SELECT *, {moments(i, f'g + {K.SOFTMAX_L2} * w')} FROM aw{j} LEFT JOIN
      (SELECT term, label, sum(weight * r) AS g FROM sx JOIN ae{i} USING (doc_id) GROUP BY ALL)
      USING (term, label)))"""
    return ctes


@query(f"""WITH {_softmax_ctes('true', 0)}, {_adam_ctes()}
  SELECT term, label, round(w, 6) + 0.0 AS w FROM aw{_BATCHES * _EPOCHS} UNION ALL
  SELECT '', label, round(b, 6) + 0.0 FROM ab{_BATCHES * _EPOCHS}""")
def adam_batches(spark, sf):
    """Weights and bias after two epochs of two batches each."""
    docs = _language_docs(spark, sf)
    rows = docs.count()
    model = softmax.train_softmax(docs, [_PLAIN], _EPOCHS, trainer=batches.BatchTrainer,
                                  batch_size=-(-rows // _BATCHES))
    names = F.array(*[F.lit(c) for c in model.classes])
    bias = spark.range(1).select(F.lit("").alias("term"), F.array(
        *[F.lit(b) for b in model.bias]).alias("w"))
    return model.terms.select("term", "w").unionByName(bias).select(
        "term", F.explode(F.arrays_zip(names.alias("label"), F.col("w"))).alias("e")).select(
            "term", "e.label", (F.round("e.w", 6) + F.lit(0.0)).alias("w"))


_STEPS = 8
_CURVE = "".join(f""", {_softmax_scores(f'vp{i}', 'vl', 'vx', i)},
  vt{i} AS (SELECT vl.label AS tr, arg_min(p.label, {{'a': -p, 'b': p.label}}) AS pred
    FROM vp{i} p JOIN vl USING (doc_id) GROUP BY p.doc_id, vl.label),
  f{i} AS (SELECT round(avg(f), 4) AS f1 FROM (SELECT coalesce(2.0 * count(*) FILTER (WHERE tr = label
      AND pred = label) / nullif(count(*) FILTER (WHERE tr = label) + count(*) FILTER (WHERE
      pred = label), 0), 0) AS f FROM vt{i} CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr'])
      AS label) GROUP BY label))""" for i in range(1, _STEPS + 1))


@query(f"""WITH {_softmax_ctes('doc_id % 5 > 0', _STEPS)},
  vl AS (SELECT doc_id, text, lang AS label FROM documents WHERE doc_id % 5 = 0),
  vc AS ({word_counts('vl', 'doc_id', 1)}), vx AS MATERIALIZED ({tfidf('vc', 'sv', 'doc_id')})
  {_CURVE},
  al AS ({' UNION ALL '.join(f'SELECT {i} AS epochs, f1 FROM f{i}' for i in range(1, _STEPS + 1))}),
  im AS (SELECT *, f1 > coalesce(max(f1) OVER (ORDER BY epochs ROWS BETWEEN UNBOUNDED PRECEDING AND
           1 PRECEDING), -1) AS better FROM al),
  la AS (SELECT *, epochs - max(CASE WHEN better THEN epochs END) OVER (ORDER BY epochs) AS waited
         FROM im)
  SELECT epochs, f1 AS macro_f1, (SELECT count(*) FROM vl) AS n FROM la WHERE epochs <=
    coalesce((SELECT min(epochs) FROM la WHERE waited >= 3), {_STEPS})""")
def early_stop_curve(spark, sf):
    """Validation macro F1 of every step of one run, stopped after three without a gain."""
    docs = _language_docs(spark, sf).withColumn("general", F.col("label"))
    train, val = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    counts = features.count_terms(train, [_PLAIN], keep=["label"])
    trainer = softmax.SoftmaxTrainer(train, features.fit(train, [_PLAIN], counts=counts),
                                     counts=counts)
    tried = features.count_terms(val, [_PLAIN])

    def score(model):
        p = model.probabilities(val, keep=["general"], counts=tried)
        pairs = p.select(F.col("general").alias("true"), D.top(D.marginals(
            F.col("probabilities"), trainer.classes))["name"].alias("pred"))
        return metrics.summary(metrics.pair_counts(pairs), ["de", "en", "es", "fr"]
                               ).first()["macro_f1"]

    _, _, history = softmax.early_stop(trainer.steps(_STEPS), score)
    rows = val.agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.explode(F.array(*[
        F.struct(F.lit(e).alias("epochs"), F.lit(v).alias("macro_f1"), F.col("n"))
        for e, v in history])).alias("r")).select("r.*")


# ------------------------------------------------------------------------------------ predictions

_MESSAGES = (r"(SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, "
             r"substring(regexp_replace(text, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g'), 1, "
             f"{K.MAX_INPUT_CHARS}) AS text FROM conversations)")
_CONTENT = (f"length(list_filter(regexp_extract_all({norm('text')}, '[a-zçğıöşüâîû]+'), "
            f"lambda t: length(t) > 1 AND t NOT IN {in_list(STOPWORDS)})) > 0")


def _messages(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


@query(f"""WITH msg AS (SELECT *, {_CONTENT} AS content FROM {_MESSAGES}), {nb_ctes()},
  {nb_scores('msg', 'id')}, {_decided('id')},
  gs AS (SELECT id, string_agg(general || ':' || printf('%.4f', p), ' ' ORDER BY general) AS scores,
           string_agg(general, ' ' ORDER BY general) FILTER (WHERE p >= 0.2 AND general <> '{OTHER}'
             AND general <> argmax) AS related
         FROM qg JOIN qd USING (id) GROUP BY id),
  sb AS (SELECT id, subtopic, p / sum(p) OVER (PARTITION BY id) AS s, row_number() OVER (
           PARTITION BY id ORDER BY p DESC, subtopic) AS k FROM qp JOIN qd USING (id)
         WHERE qp.general = argmax AND status = 'ok' AND subtopic IS NOT NULL),
  st AS (SELECT id, string_agg(subtopic, ' ' ORDER BY k) AS subtopics FROM sb
         WHERE k = 1 OR (k <= 3 AND s >= 0.15) GROUP BY id)
  SELECT msg.id, CASE WHEN content THEN status ELSE 'empty' END AS status,
    CASE WHEN NOT content THEN NULL WHEN status = 'uncertain' THEN 'unsure' ELSE argmax END
      AS general,
    CASE WHEN content THEN round(confidence, 4) ELSE 0.0 END AS confidence,
    CASE WHEN content THEN argmax END AS top_guess, CASE WHEN content THEN scores END AS scores,
    CASE WHEN content THEN coalesce(subtopics, '') ELSE '' END AS subtopics,
    CASE WHEN content THEN coalesce(related, '') ELSE '' END AS related
  FROM msg JOIN qd USING (id) JOIN gs USING (id) LEFT JOIN st USING (id)""")
def predict_messages(spark, sf):
    """The full prediction record of chat messages."""
    model = _bayes(spark, sf).with_decision(1.0, MIN_CONFIDENCE)
    p = linear.predict(model, _messages(spark, sf), "id", stopwords=STOPWORDS, other=OTHER,
                       uncertain="unsure")
    scores = F.array_join(F.transform(
        F.array_sort(F.map_entries("general_scores")),
        lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.4f", e["value"]))), " ")
    names = lambda c: F.array_join(F.transform(c, lambda s: s["name"]), " ")
    related = F.array_join(F.array_sort(F.transform("related_topics", lambda s: s["name"])), " ")
    return p.select("id", "status", "general", "confidence",
                    "top_guess", scores.alias("scores"), names("subtopics").alias("subtopics"),
                    related.alias("related"))


@query(f"""WITH msg AS (SELECT *, {_CONTENT} AS content FROM {_MESSAGES}), {nb_ctes()},
  {nb_scores('msg', 'id')}, {_decided('id')}
  SELECT msg.id, CASE WHEN content THEN status ELSE 'empty' END AS status,
    CASE WHEN NOT content THEN NULL WHEN status = 'uncertain' THEN 'unsure' ELSE argmax END
      AS general, CASE WHEN content THEN round(confidence, 4) ELSE 0.0 END AS confidence
  FROM msg JOIN qd USING (id)""")
def stream_predictions(spark, sf):
    """Raw messages scored as they arrive, in several batches, by a fixed model."""
    model = _bayes(spark, sf).with_decision(1.0, MIN_CONFIDENCE)
    source = materialize(_messages(spark, sf).select("id", "text", (F.col("id") % 3).alias("part")),
                         "part").inputFiles()[0].rsplit("/", 2)[0]
    stream = spark.readStream.schema("id long, text string, part int").option(
        "maxFilesPerTrigger", 2).parquet(source)
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    run = stage_predictions(stream, model, f"{folder}/out", f"{folder}/state", "id",
                            stopwords=STOPWORDS, other=OTHER, uncertain="unsure")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "status", "general", "confidence")


# ------------------------------------------------------------------------------------ decisions
# The decision and metric queries work on the scores of naive Bayes for all documents.

_CLS = ", ".join(f"'{c}'" for c in CLASSES)


def _probs_sql(temperature: float = 1.0) -> str:
    """px: class probabilities; qg: general ones; qt: the best; lab has the true labels."""
    return f"""{nb_ctes()}, {nb_scores('documents', 'doc_id')},
  px AS (SELECT doc_id, label AS class, split_part(label, ' > ', 1) AS general,
           nullif(split_part(label, ' > ', 2), '') AS subtopic,
           e / sum(e) OVER (PARTITION BY doc_id) AS p
         FROM (SELECT *, exp((z - max(z) OVER (PARTITION BY doc_id)) / {temperature}) AS e
               FROM qs)),
  qg AS (SELECT doc_id, general, sum(p) AS p FROM px GROUP BY ALL),
  qt AS (SELECT doc_id, arg_min(general, {{'a': -p, 'b': general}}) AS top, max(p) AS confidence
         FROM qg GROUP BY doc_id)"""


def _scored(spark, sf):
    """(doc_id, logits, target, truth, category, source) of all documents, trained and written."""
    docs = labelled(spark, sf)
    block = word_block((), 1)
    counts = features.count_terms(docs, [block], keep=["label"])
    model = linear.train_naive_bayes(docs, [block], counts=counts)
    names = F.array(*[F.lit(c) for c in CLASSES])
    about = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("category"), F.col("lang").alias("source"))
    return materialize(model.logits(docs, keep=["label"], counts=counts).join(
        about, "doc_id").select(
            "doc_id", "logits", F.col("label").alias("truth"), "category", "source",
            (F.array_position(names, F.col("label")) - 1).cast("int").alias("target")))


def _tops(spark, sf, temperature=1.0):
    s = _scored(spark, sf).withColumn("p", D.softmax(F.col("logits"), temperature))
    s = s.withColumn("g", D.marginals(F.col("p"), CLASSES)).withColumn("t", D.top(F.col("g")))
    return s.withColumns({"top": F.col("t.name"), "confidence": F.col("t.score"),
                          "true": D.split_joint(F.col("truth"))["general"]})


@query(f"""WITH {_probs_sql(1.7)} SELECT doc_id, class, round(p, 6) AS p FROM px""")
def scaled_softmax(spark, sf):
    p = _scored(spark, sf).select("doc_id", F.posexplode(D.softmax(F.col("logits"), 1.7))
                                  .alias("i", "p"))
    names = F.array(*[F.lit(c) for c in CLASSES])
    return p.select("doc_id", F.get(names, F.col("i")).alias("class"), F.round("p", 6).alias("p"))


@query(f"""WITH {_probs_sql()} SELECT doc_id, general, subtopic, round(p, 6) AS p,
  round(sum(p) OVER (PARTITION BY doc_id, general), 6) AS marginal,
  round(p / sum(p) OVER (PARTITION BY doc_id, general), 6) AS share
  FROM px WHERE subtopic IS NOT NULL""")
def topic_marginals(spark, sf):
    s = _tops(spark, sf)
    each = s.select("doc_id", "p", F.explode("g").alias("g"))
    cond = D.conditionals(D.joint_scores(F.col("p"), CLASSES), F.col("g.name"), F.col("g.score"))
    rows = each.select("doc_id", F.col("g.name").alias("general"), F.col("g.score").alias("m"),
                       F.explode(cond).alias("c"))
    return rows.select("doc_id", "general", F.col("c.name").alias("subtopic"),
                       F.round(F.col("c.score") * F.col("m"), 6).alias("p"),
                       F.round("m", 6).alias("marginal"), F.round("c.score", 6).alias("share"))


@query(f"""WITH {_probs_sql()} SELECT doc_id, round(confidence, 6) AS confidence,
  CASE WHEN top = '{OTHER}' THEN 'out_of_scope' WHEN confidence < {MIN_CONFIDENCE}
    THEN 'uncertain' ELSE 'ok' END AS status,
  CASE WHEN top = '{OTHER}' THEN '{OTHER}' WHEN confidence < {MIN_CONFIDENCE}
    THEN 'unsure' ELSE top END AS label FROM qt""")
def decide_status(spark, sf):
    s = _tops(spark, sf)
    d = D.decide(F.col("top"), F.col("confidence"), MIN_CONFIDENCE, OTHER, "unsure")
    return s.select("doc_id", F.round("confidence", 6).alias("confidence"), d["status"]
                    .alias("status"), d["label"].alias("label"))


@query(f"""WITH {_probs_sql()}, s AS (SELECT doc_id, class, p, row_number() OVER (
    PARTITION BY doc_id ORDER BY p DESC, class) AS k FROM px)
  SELECT doc_id, string_agg(class || '=' || printf('%.4f', p), '; ' ORDER BY k) AS chosen
  FROM s WHERE k <= 3 AND (k = 1 OR p >= 0.15) GROUP BY doc_id""")
def subtopics_topk(spark, sf):
    """The best class always, others from a share of 0.15, at most three."""
    s = _scored(spark, sf)
    p = D.softmax(F.col("logits"))
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col("p")[i].alias("score"))
                     for i, c in enumerate(CLASSES)])
    s = s.withColumn("p", p).withColumn("c", D.select_subtopics(each))
    return s.select("doc_id", F.array_join(F.transform("c", lambda x: F.concat(
        x["name"], F.lit("="), F.format_string("%.4f", x["score"]))), "; ").alias("chosen"))


@query(f"""WITH {_probs_sql()} SELECT qt.doc_id, coalesce(string_agg(general, ' ' ORDER BY p DESC,
  general) FILTER (WHERE general <> top AND general <> '{OTHER}' AND p >= 0.2), '') AS related
  FROM qt JOIN qg USING (doc_id) GROUP BY qt.doc_id""")
def related_topics(spark, sf):
    s = _tops(spark, sf)
    related = D.related_topics(F.col("g"), F.col("top"), OTHER)
    return s.select("doc_id", F.array_join(F.transform(related, lambda x: x["name"]), " ")
                    .alias("related"))


# ------------------------------------------------------------------------------------ metrics

_PAIRS = f"""{_probs_sql()},
  pr AS (SELECT qt.*, split_part(lab.label, ' > ', 1) AS tr FROM qt JOIN lab USING (doc_id)),
  lb AS (SELECT unnest({list(LABELS)!r}) AS label)"""


def _report_sql(pairs: str, by: str = "") -> str:
    """CTEs per (by, label): precision, recall, f1, support."""
    b = f"{by}, " if by else ""
    base = f"(SELECT DISTINCT {by} FROM {pairs}) CROSS JOIN lb" if by else "lb"
    on = f"l.{by} = p.{by} AND " if by else ""
    return f"""
  ct AS (SELECT {f'l.{by}, ' if by else ''}l.label,
    count(*) FILTER (WHERE p.tr = l.label AND p.pred = l.label) AS tp,
    count(*) FILTER (WHERE p.pred = l.label) AS predicted,
    count(*) FILTER (WHERE p.tr = l.label) AS support
    FROM (SELECT * FROM {base}) l LEFT JOIN {pairs} p ON {on}(p.tr = l.label OR p.pred = l.label)
      AND p.tr IN (SELECT label FROM lb) AND p.pred IN (SELECT label FROM lb) GROUP BY ALL),
  rt AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
    coalesce(tp / nullif(support, 0), 0.0) AS recall FROM ct),
  rp AS (SELECT {b}label, precision, recall, support,
    coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM rt)"""


def _pairs(spark, sf):
    return metrics.pair_counts(_tops(spark, sf), "true", "top")


@query(f"""WITH {_PAIRS} SELECT a.label AS "true", b.label AS pred, count(pr.doc_id) AS n
  FROM lb a CROSS JOIN lb b LEFT JOIN pr ON pr.tr = a.label AND pr.top = b.label GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return metrics.confusion(_pairs(spark, sf), LABELS)


@query(f"""WITH {_PAIRS}, pp AS (SELECT tr, top AS pred FROM pr), {_report_sql('pp')}
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    support FROM rp""")
def class_report(spark, sf):
    r = metrics.class_report(_pairs(spark, sf), LABELS)
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


_AVERAGES = """round(avg(precision), 4) AS precision_macro, round(avg(recall), 4) AS recall_macro,
    round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1"""


@query(f"""WITH {_PAIRS}, pp AS (SELECT tr, top AS pred FROM pr), {_report_sql('pp')}
  SELECT (SELECT count(*) FROM pp) AS n,
    (SELECT round(avg((tr = pred)::INT), 4) FROM pp) AS accuracy, {_AVERAGES} FROM rp""")
def macro_summary(spark, sf):
    return metrics.summary(_pairs(spark, sf), LABELS)


_TERM = ("array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), "
         "' '), 1, 2), ' ')")


@query(f"""WITH {nb_ctes()}, tm AS (SELECT doc_id, {_TERM} AS text FROM documents),
  {nb_scores('tm', 'doc_id')},
  qg AS (SELECT doc_id, general, sum(p) AS p FROM qp GROUP BY ALL),
  pp AS (SELECT split_part(any_value(lab.label), ' > ', 1) AS tr,
           arg_min(general, {{'a': -round(p, 9), 'b': general}}) AS pred
         FROM qg JOIN lab USING (doc_id) GROUP BY doc_id),
  lb AS (SELECT unnest({list(LABELS)!r}) AS label), {_report_sql('pp')}
  SELECT (SELECT count(*) FROM pp) AS n,
    (SELECT round(avg((tr = pred)::INT), 4) FROM pp) AS accuracy, {_AVERAGES} FROM rp""")
def short_inputs(spark, sf):
    """The metrics when only the first two words of a document are known."""
    model = _bayes(spark, sf)
    terms = cards(spark, sf).select("doc_id", F.col("term").alias("text"))
    p = model.probabilities(terms).withColumn("p", F.transform(
        "probabilities", lambda x: F.round(x, 12)))
    best = D.top(F.transform(D.marginals(F.col("p"), CLASSES), lambda s: F.struct(
        s["name"].alias("name"), F.round(s["score"], 9).alias("score"))))
    truth = labelled(spark, sf).select("doc_id", D.split_joint(F.col("label"))["general"]
                                       .alias("true"))
    pairs = p.select("doc_id", best["name"].alias("pred")).join(truth, "doc_id")
    return metrics.summary(metrics.pair_counts(pairs), LABELS)


@query(f"WITH {_PAIRS} SELECT tr AS label FROM pr UNION SELECT top FROM pr")
def label_union(spark, sf):
    """All labels that occur as truth or prediction."""
    return metrics.label_union(_pairs(spark, sf))


@query(f"""WITH {_PAIRS}, pp AS (SELECT tr, top AS pred FROM pr), {_report_sql('pp')}
  SELECT 'per_class' AS report, label, round(f1, 6) AS value FROM rp
  UNION ALL SELECT 'status', status, count(*)::DOUBLE FROM (SELECT CASE WHEN top = '{OTHER}' THEN
    'out_of_scope' WHEN confidence < 0.4 THEN 'uncertain' ELSE 'ok' END AS status FROM pr)
  GROUP BY status""")
def written_reports(spark, sf):
    """Reports written as tables and read back."""
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    rows = _tops(spark, sf)     # trained and scored once for both
    build.write_report({
        "per_class": metrics.class_report(metrics.pair_counts(rows, "true", "top"), LABELS),
        "status": metrics.status_counts(_decided_rows(rows))}, folder)
    per_class = spark.read.json(f"{folder}/per_class").select(
        F.lit("per_class").alias("report"), "label", F.round("f1", 6).alias("value"))
    status = spark.read.json(f"{folder}/status").select(
        F.lit("status").alias("report"), F.col("status").alias("label"),
        F.col("n").cast("double").alias("value"))
    return per_class.unionByName(status)


_EDGES = metrics.calibration_edges()


@query(f"""WITH {_PAIRS}, b AS (SELECT length(list_filter({_EDGES!r}, lambda e: e < confidence))
    AS bin, (tr = top)::INT AS correct, confidence FROM pr),
  g AS (SELECT bin, count(*) AS n, abs(avg(correct) - avg(confidence)) AS gap FROM b GROUP BY bin)
  SELECT round(sum(n * gap) FILTER (WHERE bin BETWEEN 1 AND 15) / sum(n), 6) AS ece,
    sum(n)::BIGINT AS n FROM g""")
def calibration_error(spark, sf):
    rows = _tops(spark, sf).withColumn("correct", F.col("true") == F.col("top"))
    return metrics.calibration_error(rows).select(F.round("ece", 6).alias("ece"), "n")


@query(f"""WITH {_PAIRS}, th AS (SELECT unnest({list(K.CONFIDENCE_GRID)!r}::DOUBLE[]) AS threshold),
  pp AS (SELECT threshold, tr, CASE WHEN top <> '{OTHER}' AND confidence >= threshold THEN top
    ELSE '{OTHER}' END AS pred FROM pr CROSS JOIN th), {_report_sql('pp', 'threshold')}
  SELECT threshold, (SELECT count(*) FROM pr) AS n, (SELECT round(avg((q.tr = q.pred)::INT), 4)
    FROM pp q WHERE q.threshold = rp.threshold) AS accuracy, {_AVERAGES} FROM rp
  GROUP BY threshold""")
def threshold_grid(spark, sf):
    """All metrics for every confidence threshold from one pass."""
    return metrics.threshold_grid(_tops(spark, sf), LABELS, other=OTHER)


@query(f"""WITH {_PAIRS}, th AS (SELECT unnest({list(K.CONFIDENCE_GRID)!r}::DOUBLE[]) AS threshold),
  pp AS (SELECT threshold, tr, CASE WHEN top <> '{OTHER}' AND confidence >= threshold THEN top
    ELSE '{OTHER}' END AS pred FROM pr CROSS JOIN th), {_report_sql('pp', 'threshold')},
  gr AS (SELECT threshold, round(avg(f1), 4) AS macro_f1 FROM rp GROUP BY threshold)
  SELECT arg_min(threshold, {{'f': -macro_f1, 't': threshold}}) AS threshold,
    max(macro_f1) AS macro_f1 FROM gr""")
def threshold_choice(spark, sf):
    """The threshold of the highest macro F1, the lowest of equal ones."""
    grid = materialize(metrics.threshold_grid(_tops(spark, sf), LABELS, other=OTHER))
    best = metrics.best_threshold(grid)
    return grid.filter(F.col("threshold") == best).select("threshold", "macro_f1")


_TEMPS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)

# zy: scores of all classes as a list, and the place of the true one
_LOGITS = f"""{nb_ctes()}, {nb_scores('documents', 'doc_id')},
  zy AS MATERIALIZED (SELECT doc_id, list(z - zm) AS z, list(z - zm) FILTER (WHERE qs.label = lab.label)
      AS y FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS zm FROM qs) qs
    JOIN lab USING (doc_id) GROUP BY doc_id)"""


def _loss_sql(temperature: str) -> str:
    return (f"avg(-ln(exp(y[1] / {temperature}) / list_sum(list_transform(z, "
            f"lambda s: exp(s / {temperature}))) + 1e-12))")


@query(f"""WITH {_LOGITS}, t AS (SELECT unnest({list(_TEMPS)!r}::DOUBLE[]) AS temperature)
  SELECT temperature, round({_loss_sql('temperature')}, 6) AS nll FROM zy CROSS JOIN t
  GROUP BY temperature""")
def nll_grid(spark, sf):
    return calibration.nll_grid(_scored(spark, sf), _TEMPS).select(
        "temperature", F.round("nll", 6).alias("nll"))


# Each round keeps the cells around the best of 33 points, as the operator does.
_ROUNDS = 7
_REFINED = "".join(f""",
  g{i} AS (SELECT k, a + (b - a) * k / 32 AS x, a, b FROM i{i - 1} CROSS JOIN range(33) r(k)),
  l{i} AS MATERIALIZED (SELECT k, x, a, b, {_loss_sql('exp(x)')} AS loss FROM zy CROSS JOIN g{i}
    GROUP BY ALL),
  m{i} AS (SELECT arg_min(k, {{'l': loss, 'k': k}}) AS k FROM l{i}),
  i{i} AS (SELECT min(x) AS a, max(x) AS b FROM l{i} WHERE k BETWEEN (SELECT k FROM m{i}) - 1
    AND (SELECT k FROM m{i}) + 1)""" for i in range(1, _ROUNDS + 1))


@query(f"""WITH {_LOGITS}, i0 AS (SELECT ln(0.05::DOUBLE) AS a, ln(10::DOUBLE) AS b){_REFINED},
  bt AS (SELECT exp((a + b) / 2) AS temperature FROM i{_ROUNDS})
  SELECT round(temperature, 4) AS temperature, round({_loss_sql('temperature')}, 6) AS nll
  FROM zy CROSS JOIN bt GROUP BY temperature""")
def temperature_fit(spark, sf):
    """The temperature of least loss, and the loss."""
    rows = _scored(spark, sf)
    best = calibration.fit_temperature(rows, tolerance=1e-7)
    return calibration.nll_grid(rows, [best]).select(
        F.round("temperature", 4).alias("temperature"), F.round("nll", 6).alias("nll"))


def _decisions_sql() -> str:
    return f"""{_PAIRS}, dd AS (SELECT pr.*, d.source AS category, d.lang AS source,
    CASE WHEN top = '{OTHER}' THEN 'out_of_scope' WHEN confidence < 0.4 THEN 'uncertain' ELSE 'ok'
    END AS status FROM pr JOIN documents d USING (doc_id))"""


def _decided_rows(s):
    d = D.decide(F.col("top"), F.col("confidence"), 0.4, OTHER, "unsure")
    return s.withColumns({"status": d["status"], "argmax": F.col("top"), "general": F.col("true"),
                          "label": D.metric_label(d["status"], d["label"], OTHER)})


@query(f"""WITH {_decisions_sql()} SELECT status, count(*) AS n FROM dd GROUP BY status""")
def status_counts(spark, sf):
    return metrics.status_counts(_decided_rows(_tops(spark, sf)))


@query(f"""WITH {_decisions_sql()} SELECT count(*) AS n,
  round(1 - avg((status = 'ok')::INT), 4) AS rejected_rate FROM dd""")
def ood_rejection(spark, sf):
    return metrics.rejection(_decided_rows(_tops(spark, sf)))


@query(f"""WITH {_decisions_sql()} SELECT category, round(avg((status = 'ok')::INT), 3)
  AS false_accept FROM dd GROUP BY category ORDER BY avg((status = 'ok')::INT) DESC, category
  LIMIT 3""")
def worst_categories(spark, sf):
    """The categories with most false accepts (a top-k report)."""
    return metrics.worst_categories(_decided_rows(_tops(spark, sf)), limit=3)


@query(f"""WITH {_decisions_sql()} SELECT source, count(*) AS n, 'en' AS target,
  round(avg((top = 'en')::INT), 4) AS recall_argmax,
  round(avg((top = 'en' AND status = 'ok')::INT), 4) AS recall_with_threshold FROM dd
  GROUP BY source""")
def external_recall(spark, sf):
    rows = _decided_rows(_tops(spark, sf)).withColumn("general", F.lit("en"))
    return metrics.source_recall(rows)


@query(f"""WITH {_decisions_sql()},
  sb AS (SELECT doc_id, general, arg_min(subtopic, {{'a': -p, 'b': subtopic}}) AS subtopic FROM px
         WHERE subtopic IS NOT NULL GROUP BY ALL)
  SELECT count(*) AS n, round(avg((sb.subtopic = split_part(lab.label, ' > ', 2))::INT), 4)
    AS subtopic_accuracy FROM dd JOIN lab USING (doc_id)
  JOIN sb ON sb.doc_id = dd.doc_id AND sb.general = dd.top
  WHERE top = tr AND split_part(lab.label, ' > ', 2) <> ''""")
def subtopic_accuracy(spark, sf):
    """Subtopic accuracy where the general topic is right."""
    s = _tops(spark, sf)
    best = D.conditionals(D.joint_scores(F.col("p"), CLASSES), F.col("top"), F.col("confidence"))
    s = s.withColumns({
        "argmax": F.col("top"), "general": F.col("true"),
        "subtopic": F.when(F.size(best) > 0, D.top(best)["name"]),
        "true_subtopic": F.coalesce(D.split_joint(F.col("truth"))["subtopic"], F.lit(""))})
    return metrics.subtopic_accuracy(s)


def _quantile_sql(p: float) -> str:
    return f"""SELECT event_type AS grp, {p} AS probability,
    round(quantile_cont(value, {p}), 8) AS value FROM events GROUP BY ALL
  UNION ALL SELECT 'lineitem', {p}, round(quantile_cont(l_extendedprice::DOUBLE, {p}), 8)
    FROM lineitem"""


@query(f"""SELECT grp, probability::DOUBLE AS probability, value FROM (
  {_quantile_sql(0.5)} UNION ALL {_quantile_sql(0.95)})""")
def value_percentiles(spark, sf):
    """Exact median and 95th percentile, grouped and over a whole table."""
    events = evaluate.latency_report(table(spark, sf, "events"), "value", ["event_type"])
    prices = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double")
                                                 .alias("price"))
    whole = evaluate.latency_report(prices, "price")
    both = events.select(F.col("event_type").alias("grp"), "probability", "value").unionByName(
        whole.select(F.lit("lineitem").alias("grp"), "probability", "value"))
    return both.withColumn("value", F.round("value", 8))

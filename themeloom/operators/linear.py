"""Linear topic models (score = x.W + b) over long-form TF-IDF features.

A model is tables plus a few numbers: one row per (analyzer, term) with IDF and an array of class
weights, the class list, the bias, a temperature and a confidence threshold.  Multinomial naive
Bayes and softmax regression both fit in, so scoring has one implementation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.functions import decisions as D
from themeloom.functions import text
from themeloom.functions.binding import let
from themeloom.operators import features
from themeloom.operators.features import Counted, GroupWeights, Hashed, Ngrams, Vectorizer
from themeloom.session import materialize, sweep


@dataclass
class TopicModel:
    blocks: tuple[Ngrams, ...]
    n_docs: int                       # documents the vocabulary was learnt from
    terms: DataFrame                  # analyzer, term, df, idf, w array<double>
    classes: list[str]
    bias: list[float]
    temperature: float = 1.0
    min_confidence: float = 0.0
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.bias) != len(self.classes):
            raise ValueError("bias and classes differ in length")

    def with_decision(self, temperature: float, min_confidence: float) -> TopicModel:
        return replace(self, temperature=temperature, min_confidence=min_confidence)

    def logits(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep: Sequence[str] = (), counts: dict[str, Counted] | None = None
               ) -> DataFrame:
        """(id, *keep, logits array).  Every document gets a row; without a known term its
        scores are the bias.

        Each group of documents gets the IDF and weights of its terms by one join and adds up norm
        and scores of its documents by itself.
        """
        ids = [id_col, *keep]
        k = len(self.classes)
        blocks = [self.block_sums(b, docs, id_col, text_col, counts) for b in self.blocks]
        bias = F.array(*[F.lit(float(b)) for b in self.bias])
        out = docs.select(*ids)
        total: Column = bias
        for n, block_sums in enumerate(blocks):
            out = out.join(block_sums.withColumnRenamed("_z", f"_z{n}"), id_col, "left")
            zero = F.array_repeat(F.lit(0.0), k)
            total = F.zip_with(total, F.coalesce(F.col(f"_z{n}"), zero), lambda a, b: a + b)
        return out.select(*ids, total.alias("logits"))

    def block_sums(self, block: Ngrams, docs: DataFrame, id_col: str, text_col: str,
                   counts: dict[str, Counted] | None) -> DataFrame:
        """(id, _z): scores of every document's terms of a block."""
        k = len(self.classes)
        kind = dict(docs.select(id_col).dtypes)[id_col]

        def work(block: Ngrams, rows: pa.Table, terms: pa.Table) -> pa.Table:
            row, code, x = features.group_weights(block, rows, terms, id_col)
            unit, values = features.same_ids(rows.column(id_col))
            w = terms.column("w").combine_chunks().flatten().to_numpy().reshape(-1, k)
            z = np.stack([np.bincount(unit[row], x * w[code, i], len(values))
                          for i in range(k)], axis=1).astype(float)
            at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * k)
            return pa.table([values, pa.ListArray.from_arrays(at, pa.array(z.reshape(-1)))],
                            names=[id_col, "_z"])

        counted = (counts or {}).get(block.name) or features.in_groups(docs, block, id_col, text_col)
        table = self.terms.filter(F.col("analyzer") == block.name).select("term", "idf", "w")
        return counted.with_terms(table, work, f"`{id_col}` {kind}, _z array<double>")

    def probabilities(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: Sequence[str] = (), counts: dict[str, Counted] | None = None
                      ) -> DataFrame:
        scored = self.logits(docs, id_col, text_col, keep, counts)
        return scored.select(id_col, *keep,
                             D.softmax(F.col("logits"), self.temperature).alias("probabilities"))


TOTALS = "terms array<long>, dfs array<long>, sizes array<int>, labels array<smallint>, sums array<double>"


def _places(docs: pa.Table, label_col: str, names: pa.Array) -> np.ndarray:
    """The place of each row's label among the classes, -1 for one that isn't there."""
    return pc.index_in(docs.column(label_col), value_set=names).fill_null(-1).to_numpy()


def hashed_totals(counted: Hashed, classes: Sequence[str], label_col: str = "label"
                  ) -> tuple[DataFrame, list[float]]:
    """(_group, terms, dfs, sizes, labels, sums, owned), written: the feature mass per class of the
    terms that groups share, for each group that has them, one of which owns the term; and the mass of
    each class over all terms.

    A term has ``sizes`` places in ``labels`` and ``sums``.
    """
    block, n_docs, parts, id_col = counted.block, counted.n_docs, counted.parts, counted.id_col
    k, names = len(classes), pa.array(classes, pa.string())

    def sums(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({f: pa.array([], t) for f, t in (
                ("part", pa.int32()), ("_group", pa.int64()), ("terms", pa.list_(pa.int64())),
                ("dfs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                ("labels", pa.list_(pa.int16())), ("sums", pa.list_(pa.float64())))})
        g = features.hashed_weights(block, n_docs, docs, told, id_col)
        label = _places(docs, label_col, names)[g.row]
        here = g.shared[g.code] & (label >= 0)
        key, at = np.unique(g.code[here] * k + label[here], return_inverse=True)
        total = np.bincount(at, g.weight[here], len(key))
        code, by = key // k, key % k
        part = np.mod(g.hashes[code], parts)
        order = np.lexsort((by, code, part))
        code, by, total, part = code[order], by[order], total[order], part[order]
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
        size = np.diff(np.append(new, len(code)))
        some, first = np.unique(part[new], return_index=True)
        # the classes' mass stands by itself
        ends = np.concatenate([first, [len(new)] * 2])
        flat_ends = np.append(np.append(new, len(code))[ends[:-1]], len(code) + k)
        mass = np.bincount(label[label >= 0], g.weight[label >= 0], k)
        return pa.table(
            [pa.array(np.append(some, -1).astype(np.int32)),
             pa.array(np.full(len(some) + 1, docs.column("_group")[0].as_py())),
             features.listed(ends, g.hashes[code[new]]), features.listed(ends, g.df[code[new]]),
             features.listed(ends, size.astype(np.int32)),
             features.listed(flat_ends, np.append(by, np.arange(k)).astype(np.int16)),
             features.listed(flat_ends, np.append(total, mass))],
            names=["part", "_group", "terms", "dfs", "sizes", "labels", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        label, part_sum = features.flat(rows, "labels"), features.flat(rows, "sums")
        if rows.column("part")[0].as_py() < 0:
            mass = np.bincount(label, part_sum, k)
            return pa.table([pa.array([features.ALL]), *(
                features.listed([0, len(v)], v, t) for v, t in (
                    ([], pa.int64()), ([], pa.int64()), ([], pa.int32()),
                    (np.arange(k), pa.int16()), (mass, pa.float64()), ([], pa.bool_())))],
                names=["_group", "terms", "dfs", "sizes", "labels", "sums", "owned"])
        group = np.repeat(rows.column("_group").to_numpy(), features.list_sizes(rows, "terms"))
        size, df = features.flat(rows, "sizes"), features.flat(rows, "dfs")
        term, number = np.unique(features.flat(rows, "terms"), return_inverse=True)
        key, at = np.unique(np.repeat(number, size).astype(np.int64) * k + label,
                            return_inverse=True)
        total = np.bincount(at, part_sum, len(key))
        first = np.searchsorted(key // k, np.arange(len(term) + 1))
        order = np.argsort(group, kind="stable")
        _, owner = np.unique(number[order], return_index=True)
        owned = np.zeros(len(order), bool)
        owned[owner] = True
        own = number[order]
        sizes = first[own + 1] - first[own]
        flat_ends = np.append(0, np.cumsum(sizes))
        place = np.repeat(first[own] - flat_ends[:-1], sizes) + np.arange(flat_ends[-1])
        groups, start = np.unique(group[order], return_index=True)
        ends = np.append(start, len(order))
        return pa.table(
            [pa.array(groups), features.listed(ends, term[own]), features.listed(ends, df[order]),
             features.listed(ends, sizes.astype(np.int32)),
             features.listed(flat_ends[ends], (key[place] % k).astype(np.int16)),
             features.listed(flat_ends[ends], total[place]), features.listed(ends, owned)],
            names=["_group", "terms", "dfs", "sizes", "labels", "sums", "owned"])

    shared = counted.shared.filter(F.col("_group") != features.ALL)
    totals = materialize(counted.in_groups(shared, sums, f"part int, _group long, {TOTALS}").groupBy(
        "part").applyInArrow(added, f"_group long, {TOTALS}, owned array<boolean>"))
    sweep(totals.sparkSession)
    mass = totals.filter(F.col("_group") == features.ALL).select("sums").first()
    return totals.filter(F.col("_group") != features.ALL), list(mass[0]) if mass else [0.0] * k


def group_masses(g: GroupWeights, docs: pa.Table, told: pa.Table, classes: Sequence[str],
                 label_col: str) -> np.ndarray:
    """Feature mass (place, class) of a group's terms over all documents, where ``told`` are rows of
    ``hashed_totals``; only right for terms that are not shared or told."""
    k = len(classes)
    label = _places(docs, label_col, pa.array(classes, pa.string()))[g.row]
    here = label >= 0
    mass = np.bincount(g.code[here] * k + label[here], g.weight[here], len(g.terms) * k)
    if told.num_rows:
        at = np.repeat(g.place(features.flat(told, "terms")), features.flat(told, "sizes"))
        mass[at * k + features.flat(told, "labels")] = features.flat(told, "sums")
    return mass.reshape(-1, k)


def owned_terms(g: GroupWeights, told: pa.Table) -> np.ndarray:
    """Places of the terms in the vocabulary that this group has to itself or owns."""
    mine = ~g.shared
    if told.num_rows:
        owned = told.column("owned").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        mine[g.place(features.flat(told, "terms")[owned.astype(bool)])] = True
    return np.flatnonzero(mine & ~np.isnan(g.idf))


def term_totals(counted: Hashed, classes: Sequence[str], label_col: str = "label") -> DataFrame:
    """(term, label, total): feature mass of every class that has the term."""
    shared, _ = hashed_totals(counted, classes, label_col)
    block, n_docs, id_col, names = counted.block, counted.n_docs, counted.id_col, pa.array(classes)

    def work(docs: pa.Table, told: pa.Table) -> pa.Table:
        g = features.hashed_weights(block, n_docs, docs, told, id_col)
        mass = group_masses(g, docs, told, classes, label_col)
        mine = owned_terms(g, told)
        at, label = np.nonzero(mass[mine] > 0)
        return pa.table([g.terms.take(pa.array(mine[at])), names.take(pa.array(label)),
                         pa.array(mass[mine[at], label])], names=["term", "label", "total"])

    return counted.in_groups(shared, work, "term string, label string, total double")


@dataclass
class GroupedBayes(TopicModel):
    """Naive Bayes over hashed groups.  Documents of these groups are scored inside them; ``terms``
    is worked out of the groups where it is read."""

    counted: dict[str, Hashed] = field(default_factory=dict)
    totals: dict[str, DataFrame] = field(default_factory=dict)
    label_col: str = "label"
    alpha: float = K.NB_ALPHA
    norms: list[float] = field(default_factory=list)

    def block_sums(self, block: Ngrams, docs: DataFrame, id_col: str, text_col: str,
                   counts: dict[str, Counted] | None) -> DataFrame:
        counted = self.counted[block.name]
        if (counts or {}).get(block.name) is not counted:
            return super().block_sums(block, docs, id_col, text_col, counts)
        kind = dict(docs.select(id_col).dtypes)[id_col]
        n_docs, classes, label_col, alpha, norms, k = (
            counted.n_docs, self.classes, self.label_col, self.alpha, self.norms, len(self.classes))

        def work(rows: pa.Table, told: pa.Table) -> pa.Table:
            g = features.hashed_weights(block, n_docs, rows, told, id_col)
            mass = group_masses(g, rows, told, classes, label_col)
            unit, values = features.same_ids(rows.column(id_col))
            z = np.stack([np.bincount(
                unit[g.row], g.weight * (np.log(mass[:, i] + alpha) - norms[i])[g.code],
                len(values)) for i in range(k)], axis=1).astype(float)
            at = np.arange(len(values) + 1) * k
            return pa.table([values, features.listed(at, z.reshape(-1))], names=[id_col, "_z"])

        return counted.in_groups(self.totals[block.name], work, f"`{id_col}` {kind}, _z array<double>")


def _bayes_terms(counted: Hashed, totals: DataFrame, classes: Sequence[str], label_col: str,
                 alpha: float, norms: Sequence[float]) -> DataFrame:
    """(analyzer, term, df, idf, w) of a block."""
    block, n_docs, id_col, k = counted.block, counted.n_docs, counted.id_col, len(classes)

    def work(docs: pa.Table, told: pa.Table) -> pa.Table:
        g = features.hashed_weights(block, n_docs, docs, told, id_col)
        mine = owned_terms(g, told)
        w = np.log(group_masses(g, docs, told, classes, label_col)[mine] + alpha) - np.array(norms)
        return pa.table([g.terms.take(pa.array(mine)), pa.array(g.df[mine]), pa.array(g.idf[mine]),
                         features.listed(np.arange(len(mine) + 1) * k, w.reshape(-1))],
                        names=["term", "df", "idf", "w"])

    return counted.in_groups(
        totals, work, "term string, df long, idf double, w array<double>").select(
            F.lit(block.name).alias("analyzer"), "term", "df", "idf", "w")


def _train_hashed(labelled: DataFrame, blocks: Sequence[Ngrams], alpha: float, bias: list[float],
                  classes: list[str], label_col: str, counts: dict[str, Hashed]) -> TopicModel:
    totals, mass = {}, np.zeros(len(classes))
    for block in blocks:
        totals[block.name], own = hashed_totals(counts[block.name], classes, label_col)
        mass += own
    n_terms = sum(counts[b.name].n_terms for b in blocks)
    norms = np.log(mass + alpha * n_terms).tolist()
    terms = None
    for block in blocks:
        part = _bayes_terms(counts[block.name], totals[block.name], classes, label_col, alpha, norms)
        terms = part if terms is None else terms.unionByName(part)
    return GroupedBayes(tuple(blocks), counts[blocks[0].name].n_docs, terms, classes, bias,
                        counted=counts, totals=totals, label_col=label_col, alpha=alpha, norms=norms)


def class_list(labelled: DataFrame, label_col: str = "label") -> list[str]:
    """Sorted classes: the labels of a taxonomy."""
    return sorted(r[0] for r in labelled.select(label_col).distinct().collect())


def class_totals(vectors: DataFrame, classes: Sequence[str], label_col: str = "label") -> DataFrame:
    """(analyzer, term, totals array): feature mass per class.

    ``vectors`` are rows (analyzer, term, label, weight), best with the sums of ``Vectorizer.sums``.
    Classes are rows while sums are taken; a term then gathers one number for each class that it
    occurs in, in the same partition.
    """
    sums = vectors.repartition("analyzer", "term").groupBy("analyzer", "term", label_col).agg(
        F.sum("weight").alias("_t"))
    own = sums.groupBy("analyzer", "term").agg(
        F.map_from_entries(F.collect_list(F.struct(label_col, "_t"))).alias("_by"))
    names = F.array(*[F.lit(c) for c in classes])
    return own.select("analyzer", "term", let(F.col("_by"), lambda by: F.transform(
        names, lambda c: F.coalesce(F.try_element_at(by, c), F.lit(0.0)))).alias("totals"))


def train_naive_bayes(labelled: DataFrame, blocks: Sequence[Ngrams], alpha: float = K.NB_ALPHA,
                      uniform_prior: bool = True, id_col: str = "doc_id", text_col: str = "text",
                      label_col: str = "label", vectorizer: Vectorizer | None = None,
                      counts: dict[str, Counted] | None = None) -> TopicModel:
    """Multinomial naive Bayes on TF-IDF weights with Laplace smoothing.

    Groups of documents are written once for vocabulary and sums; ``counts`` are such groups with
    the label kept, if the caller already has them; with those of ``features.hash_terms`` no table of
    terms is written.
    """
    classes = class_list(labelled, label_col)
    k = len(classes)
    if uniform_prior:
        bias = [math.log(1.0 / k)] * k
    else:
        found = {r[label_col]: r["n"] for r in
                 labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(found.values())
        bias = [math.log(found[c] / total) for c in classes]
    if counts and all(isinstance(c, Hashed) for c in counts.values()):
        return _train_hashed(labelled, blocks, alpha, bias, classes, label_col, counts)
    if vectorizer is None:
        if counts is None:
            counts = features.count_terms(labelled, blocks, id_col, text_col, [label_col])
        vectorizer = features.fit(labelled, blocks, id_col, text_col, counts)
    sums = vectorizer.sums(labelled, label_col, id_col, text_col, counts)
    totals = class_totals(sums, classes, label_col)
    # One written table holds the trained sums; the normalisers below are K numbers.
    table = materialize(vectorizer.vocabulary.join(totals, ["analyzer", "term"], "left"))
    zero = F.array_repeat(F.lit(0.0), k)
    mass = F.coalesce(F.col("totals"), zero)
    n_terms = table.count()
    sums = {r["i"]: r["z"] for r in table.select(F.posexplode("totals").alias("i", "t")).groupBy(
        "i").agg(F.sum("t").alias("z")).collect()}
    norms = [math.log(sums.get(i, 0.0) + alpha * n_terms) for i in range(k)]
    weights = F.array(*[F.log(mass[i] + F.lit(alpha)) - F.lit(norms[i]) for i in range(k)])
    return TopicModel(tuple(vectorizer.blocks), vectorizer.n_docs,
                      table.select("analyzer", "term", "df", "idf", weights.alias("w")),
                      classes, bias)


def predict(model: TopicModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            max_chars: int | None = K.MAX_INPUT_CHARS,
            stopwords: Sequence[str] = K.STOPWORDS, other: str = K.OTHER_LABEL,
            uncertain: str = K.UNCERTAIN_LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """The full prediction record of every text.

    ``max_chars`` is the input limit of an interactive message; ``None`` scores whole texts.
    Texts without content words have status "empty" and no scores.
    """
    ids = [id_col, *keep]
    if max_chars is None:
        shaped = F.struct(text.strip(F.col(text_col)).alias("text"), F.lit(False).alias("truncated"))
    else:
        shaped = text.clip(F.col(text_col), max_chars)
    inputs = docs.select(*ids, F.col(text_col).alias("text"), shaped.alias("_in")).select(
        *ids, "text", F.col("_in.text").alias("_clean"), F.col("_in.truncated").alias("truncated"))
    inputs = inputs.withColumn("_content", text.has_content(
        text.normalize(F.col("_clean")), stopwords))
    filled = inputs.filter("_content")
    scored = model.probabilities(filled, id_col, "_clean").withColumnRenamed(id_col, "_id")
    joined = inputs.join(scored, F.col(id_col) == F.col("_id"), "left").drop("_id")
    return decision_record(joined, model.classes, model.min_confidence, ids, other, uncertain)


def decision_record(scored: DataFrame, classes: Sequence[str], min_confidence: float,
                    ids: Sequence[str], other: str = K.OTHER_LABEL,
                    uncertain: str = K.UNCERTAIN_LABEL) -> DataFrame:
    """Prediction record from (ids, text, truncated, probabilities); null scores mean empty."""
    p = F.col("probabilities")
    step = (
        scored.withColumn("_general", F.when(p.isNotNull(), D.marginals(p, classes)))
        .withColumn("_joint", F.when(p.isNotNull(), D.joint_scores(p, classes)))
        .withColumn("_top", D.top(F.col("_general")))
        .withColumn("_decision", D.decide(F.col("_top.name"), F.col("_top.score"),
                                          min_confidence, other, uncertain))
        .withColumn("_conditional", D.conditionals(F.col("_joint"), F.col("_top.name"),
                                                   F.col("_top.score")))
    )
    empty = p.isNull()
    none = F.array().cast("array<struct<name:string,score:double>>")
    status = F.when(empty, K.STATUS_EMPTY).otherwise(F.col("_decision.status"))
    ranked = D.ranked(F.col("_general"))
    generals = F.map_from_entries(F.transform(
        ranked, lambda s: F.struct(s["name"], D.round4(s["score"]))))
    subtopic_maps = F.map_from_entries(F.filter(F.transform(
        F.col("_general"),
        lambda g: F.struct(g["name"].alias("key"), F.map_from_entries(F.transform(
            F.filter(F.col("_joint"), lambda j: j["general"] == g["name"]),
            lambda j: F.struct(j["subtopic"], D.round4(j["p"])))).alias("value"))),
        lambda e: F.size(F.map_keys(e["value"])) > 0))
    return step.select(
        *ids, "text", status.alias("status"),
        F.when(~empty, F.col("_decision.label")).alias("general"),
        F.when(empty, 0.0).otherwise(D.round4(F.col("_top.score"))).alias("confidence"),
        F.when(~empty, generals).alias("general_scores"),
        F.when(empty, none).when(status == K.STATUS_OK, D.select_subtopics(F.col("_conditional")))
        .otherwise(none).alias("subtopics"),
        F.when(empty, none).otherwise(D.related_topics(
            F.col("_general"), F.col("_top.name"), other)).alias("related_topics"),
        F.when(~empty, F.col("_top.name")).alias("top_guess"),
        F.when(~empty, subtopic_maps).alias("joint_subtopic_scores"),
        "truncated",
    )


def decisions(model: TopicModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              keep: Sequence[str] = (), other: str = K.OTHER_LABEL,
              uncertain: str = K.UNCERTAIN_LABEL,
              counts: dict[str, Counted] | None = None) -> DataFrame:
    """Batch decisions for evaluation: (id, *keep, argmax, confidence, status, label, subtopic).

    ``label`` counts uncertain texts as the out-of-taxonomy label; texts are scored whole.
    """
    p = model.probabilities(docs, id_col, text_col, keep, counts)
    c = model.classes
    step = (
        p.withColumn("_general", D.marginals(F.col("probabilities"), c))
        .withColumn("_top", D.top(F.col("_general")))
        .withColumn("_d", D.decide(F.col("_top.name"), F.col("_top.score"),
                                   model.min_confidence, other, uncertain))
        .withColumn("_sub", D.conditionals(D.joint_scores(F.col("probabilities"), c),
                                           F.col("_top.name"), F.col("_top.score")))
    )
    return step.select(
        id_col, *keep, F.col("_top.name").alias("argmax"), F.col("_top.score").alias("confidence"),
        F.col("_d.status").alias("status"),
        D.metric_label(F.col("_d.status"), F.col("_d.label"), other).alias("label"),
        F.when(F.size("_sub") > 0, D.top(F.col("_sub"))["name"]).alias("subtopic"))

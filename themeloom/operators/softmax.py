"""Class-weighted softmax regression on long-form features, with weights as rows.

A model is a table with one row per (analyzer, term), so its size is bounded by the cluster.  A step
sends each group of documents the weights of its terms, takes scores, residuals and the gradient
there and sums the groups' gradients by term: full-batch gradient descent with momentum.
Each step is written, so a step is a snapshot, a run stops at any of them, and one run serves every
training length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.operators import features
from themeloom.operators.features import Counted, Ngrams, Vectorizer
from themeloom.operators.linear import TopicModel, class_list
from themeloom.session import materialize

# Shares add up to one and each block has unit length, which bounds the curvature: stable up to two
# blocks.
RATE = 2.0
MOMENTUM = 0.9
GROUP_ROWS = 1024       # documents of a group
NO_WEIGHTS = pa.table({"term": pa.array([], pa.string()),
                       "w": pa.array([], pa.list_(pa.float64()))})


def class_weights(labelled: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight) with weight n_rows / (classes * rows of the class)."""
    counts = labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    one = F.lit(1)
    return counts.withColumn("_j", one).join(totals.withColumn("_j", one), "_j").select(
        label_col, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def early_stop(models: Iterable[tuple[int, TopicModel]], score: Callable[[TopicModel], float],
               patience: int = K.EARLY_STOP_PATIENCE
               ) -> tuple[int, TopicModel, list[tuple[int, float]]]:
    """Best step, its model and the history; stop after ``patience`` steps without a gain."""
    best, chosen, best_score, waited, history = 0, None, float("-inf"), 0, []
    for step, model in models:
        value = score(model)
        history.append((step, value))
        if value > best_score:
            best, chosen, best_score, waited = step, model, value, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, chosen, history


class SoftmaxTrainer:
    """Prepares vectors once and runs steps on them.

    Every labelled row trains: one without a known term has the bias alone, as everywhere else.
    """

    def __init__(self, labelled: DataFrame, vectorizer: Vectorizer, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "label", l2: float = K.SOFTMAX_L2,
                 rate: float = RATE, momentum: float = MOMENTUM,
                 counts: dict[str, Counted] | None = None):
        self.vectorizer, self.l2, self.rate, self.momentum = vectorizer, l2, rate, momentum
        self.classes = class_list(labelled, label_col)
        if counts and not all(label_col in c.docs.columns for c in counts.values()):
            counts = None
        self._read(labelled, id_col, text_col, label_col, counts)

    def _read(self, labelled: DataFrame, id_col: str, text_col: str, label_col: str,
              counts: dict[str, Counted] | None) -> None:
        """Written rows (_group, _id, _label, _share, analyzer, terms, weights), a document's blocks
        in one group, and the terms of each group."""
        # class weights over their sum, which is the number of rows; one row a class
        weights = class_weights(labelled, label_col).collect()
        n_rows = sum(r.n for r in weights)
        shares = F.map_from_arrays(F.array(*[F.lit(r[label_col]) for r in weights]),
                                   F.array(*[F.lit(r.weight / n_rows) for r in weights]))
        groups = max(1, -(-n_rows // GROUP_ROWS))
        lists = self.vectorizer.lists(labelled, id_col, text_col, [label_col], counts)
        names = F.array(*[F.lit(c) for c in self.classes])
        self.vectors = materialize(lists.select(
            F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("long").alias("_group"),
            F.col(id_col).alias("_id"),
            (F.array_position(names, F.col(label_col)) - 1).cast("int").alias("_label"),
            shares[F.col(label_col)].alias("_share"), "analyzer", "terms", "weights"
        ).repartition("_group"))
        self.rows = self.vectors.filter(
            F.col("analyzer") == self.vectorizer.blocks[0].name).select("_id", "_share", "_label")
        self.terms = materialize(self.vectors.select(
            "_group", "analyzer", F.explode("terms").alias("term")).distinct())

    def _slopes(self, table: DataFrame, bias: Sequence[float]) -> DataFrame:
        """(analyzer, term, g) of each group, still to be added up; the bias has no analyzer."""
        blocks, k = [b.name for b in self.vectorizer.blocks], len(self.classes)

        def work(rows: pa.Table, terms: pa.Table) -> pa.Table:
            unit, values = features.same_ids(rows.column("_id"))
            each = []
            z = np.tile(np.array(bias, dtype=float), (len(values), 1))
            for block in blocks:
                mine = pc.equal(rows.column("analyzer"), block)
                own = rows.filter(mine)
                part = (terms.filter(pc.equal(terms.column("analyzer"), block))
                        if terms.num_rows else NO_WEIGHTS)
                term = part.column("term").combine_chunks()
                lists = own.column("terms").combine_chunks()
                code = pc.index_in(lists.flatten(), value_set=term).to_numpy(zero_copy_only=False)
                x = own.column("weights").combine_chunks().flatten().to_numpy()
                at = unit[mine.to_numpy(zero_copy_only=False)]
                at = np.repeat(at, np.diff(lists.offsets.to_numpy()))
                w = part.column("w").combine_chunks().flatten().to_numpy().reshape(-1, k)
                z += np.stack([np.bincount(at, x * w[code, i], len(values)) for i in range(k)], 1)
                each.append((block, term, at, code, x))
            # a document has a row for each block
            first = rows.filter(pc.equal(rows.column("analyzer"), blocks[0]))
            at = unit[pc.equal(rows.column("analyzer"), blocks[0]).to_numpy(zero_copy_only=False)]
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True))[at]
            p[np.arange(len(at)), first.column("_label").to_numpy()] -= 1.0
            p *= first.column("_share").to_numpy()[:, None]
            r = np.stack([np.bincount(at, p[:, i], len(values)) for i in range(k)], 1)
            out = [_slope_rows(None, pa.array([None], pa.string()), r.sum(0, keepdims=True))]
            for block, term, at, code, x in each:
                g = np.stack([np.bincount(code, x * r[at, i], len(term)) for i in range(k)], 1)
                out.append(_slope_rows(block, term, g))
            return pa.concat_tables(out)

        known = self.terms.join(table.select("analyzer", "term", "w"), ["analyzer", "term"])
        return self.vectors.groupBy("_group").cogroup(known.groupBy("_group")).applyInArrow(
            work, "analyzer string, term string, g array<double>")

    def steps(self, epochs: int) -> Iterator[tuple[int, TopicModel]]:
        """(step, model) after each of ``epochs`` steps."""
        k = len(self.classes)
        zero = F.array_repeat(F.lit(0.0), k)
        table = self.vectorizer.vocabulary.withColumns({"w": zero, "_v": zero})
        bias, speed = [0.0] * k, [0.0] * k
        key = ["analyzer", "term"]
        for step in range(1, epochs + 1):
            sums = [F.sum(F.col("g")[i]).alias(f"_g{i}") for i in range(k)]
            slopes = materialize(self._slopes(table, bias).groupBy(*key).agg(*sums))
            total = slopes.filter("analyzer is null").first() or [None] * (k + 2)
            speed = [self.momentum * v - self.rate * (g or 0.0)
                     for v, g in zip(speed, total[2:], strict=True)]
            bias = [b + v for b, v in zip(bias, speed, strict=True)]
            joined = table.join(slopes, key, "left")
            v = F.array(*[
                F.lit(self.momentum) * F.col("_v")[i] - F.lit(self.rate) * (
                    F.coalesce(F.col(f"_g{i}"), F.lit(0.0)) + F.lit(self.l2) * F.col("w")[i])
                for i in range(k)])
            moved = joined.select(*key, "df", "idf", "w", v.alias("_v"))
            table = materialize(moved.withColumn(
                "w", F.zip_with("w", "_v", lambda w, d: w + d)))
            yield step, TopicModel(tuple(self.vectorizer.blocks), self.vectorizer.n_docs,
                                   table.drop("_v"), self.classes, list(bias))


def _slope_rows(block: str | None, term: pa.Array, g: np.ndarray) -> pa.Table:
    at = pa.array(np.arange(len(g) + 1, dtype=np.int32) * g.shape[1])
    return pa.table([pa.array([block] * len(g), pa.string()), term,
                     pa.ListArray.from_arrays(at, pa.array(g.reshape(-1).astype(float)))],
                    names=["analyzer", "term", "g"])


def train_softmax(labelled: DataFrame, blocks: Sequence[Ngrams], epochs: int,
                  id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
                  l2: float = K.SOFTMAX_L2, trainer: type[SoftmaxTrainer] = SoftmaxTrainer,
                  counts: dict[str, Counted] | None = None, **options) -> TopicModel:
    """The model after ``epochs`` steps of a trainer; ``counts`` are groups with the label kept."""
    if counts is None:
        counts = features.count_terms(labelled, blocks, id_col, text_col, [label_col])
    vectorizer = features.fit(labelled, blocks, id_col, text_col, counts)
    steps = trainer(labelled, vectorizer, id_col, text_col, label_col, l2, counts=counts,
                    **options).steps(epochs)
    for _, model in steps:
        pass
    return model

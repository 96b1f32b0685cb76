"""Softmax regression by Adam over seeded batches, with weights and moments as rows.

The batch of a row is a column: an md5 of seed, epoch and id, modulo the number of batches, so that
any engine can deal the rows alike; batches have about ``batch_size`` rows.  A step joins the
batch's vectors with the weights of its own terms and writes new weights and moments (Kingma and Ba,
2015) for these terms alone; all others stay as they are.  The state of the model is a table with a
row per (term, class) that a batch has touched, and the tables that the steps since have written,
of which the row of the latest step counts; they are merged after ``MERGE`` steps and at the end of
an epoch.  So a step costs what its batch costs.  Classes are rows as well: many classes make no
plan wider.

What a batch reaches grows with ``batch_size``, an epoch has rows / batch_size steps, one after the
other: on large tables both the size of batches and the rate are to be raised.  Rows without a known
term move the bias alone; a batch without rows is no step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom.operators.joins import seeded_order
from themeloom.operators.linear import TopicModel
from themeloom.operators.softmax import SoftmaxTrainer, class_weights
from themeloom.session import materialize

BATCH_SIZE = 256
ADAM_RATE = 0.05
FIRST, SECOND, EPSILON = 0.9, 0.999, 1e-8
SEED = 42
MERGE = 16
FILE_ROWS = 1 << 16

KEY = ["analyzer", "term", "class"]
STATE = "analyzer string, term string, class int, w double, m double, v double, step int"


def batch_of(row_id: Column, epoch: int, batches: int, seed: int = SEED) -> Column:
    """The batch of a row in an epoch, from 0."""
    digest = seeded_order(seed, F.lit(epoch), row_id)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"),
                  F.lit(batches)).cast("int")


def moved(m: Column, v: Column, g: Column, step: int, rate: float) -> tuple[Column, Column, Column]:
    """New moments and the change of the weight for gradient g."""
    m = FIRST * m + (1 - FIRST) * g
    v = SECOND * v + (1 - SECOND) * g * g
    return m, v, -rate * (m / (1 - FIRST ** step)) / (F.sqrt(v / (1 - SECOND ** step)) + EPSILON)


def _latest(tables: Sequence[DataFrame], terms: DataFrame | None = None) -> DataFrame:
    """The row of the latest step for each key, of these terms alone."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    if terms is not None:
        rows = rows.join(terms, KEY[:2], "left_semi")
    last = F.max_by(F.struct("w", "m", "v"), "step").alias("s")
    return rows.groupBy(*KEY).agg(last, F.max("step").alias("step")).select(*KEY, "s.*", "step")


class BatchTrainer(SoftmaxTrainer):
    """``steps`` gives the model after each epoch; other arguments as the base's."""

    def __init__(self, labelled: DataFrame, *args, batch_size: int = BATCH_SIZE,
                 rate: float = ADAM_RATE, seed: int = SEED, **options):
        super().__init__(labelled, *args, rate=rate, **options)
        self.batch_size, self.seed = batch_size, seed
        self.batches = max(1, -(-self.rows.count() // batch_size))

    def _read(self, labelled, id_col, text_col, label_col, counts) -> None:
        """Written vectors (_id, analyzer, term, _x) and rows (_id, _share, _y)."""
        self.vectors = materialize(self.vectorizer.transform(
            labelled, id_col, text_col, counts=counts).select(
                F.col(id_col).alias("_id"), "analyzer", "term", F.col("weight").alias("_x")))
        names = F.array(*[F.lit(c) for c in self.classes])
        # class weights over their sum, which is the number of rows
        n_rows = labelled.count()
        shares = class_weights(labelled, label_col).select(
            label_col, (F.col("weight") / F.lit(n_rows)).alias("_share"))
        self.rows = materialize(labelled.select(F.col(id_col).alias("_id"), label_col).join(
            shares, label_col).select("_id", "_share", F.transform(
                names, lambda c: (c == F.col(label_col)).cast("double")).alias("_y")))

    def _dealt(self, table: DataFrame, epoch: int) -> DataFrame:
        """Written in a folder for each batch, so that a step reads its own rows."""
        files = F.pmod(F.xxhash64("_id"), F.lit(1 + self.batch_size // FILE_ROWS))
        batch = batch_of(F.col("_id"), epoch, self.batches, self.seed)
        return materialize(table.withColumn("_batch", batch).repartition("_batch", files), "_batch")

    def _residuals(self, rows: DataFrame, x: DataFrame, state: DataFrame,
                   bias: Sequence[float]) -> DataFrame:
        """(_id, class, _share, _r): weighted errors of a batch."""
        z = x.join(state, KEY[:2]).groupBy("_id", "class").agg(
            F.sum(F.col("_x") * F.col("w")).alias("_z"))
        start = F.get(F.array(*[F.lit(b) for b in bias]), F.col("class"))
        each = rows.select("_id", "_share", F.posexplode("_y").alias("class", "_y"))
        scored = each.join(z, ["_id", "class"], "left").withColumn(
            "_z", start + F.coalesce("_z", F.lit(0.0)))
        own = Window.partitionBy("_id")
        e = F.exp(F.col("_z") - F.max("_z").over(own))
        p = scored.withColumn("_e", e).withColumn("_p", F.col("_e") / F.sum("_e").over(own))
        return p.select("_id", "class", "_share",
                        (F.col("_share") * (F.col("_p") - F.col("_y"))).alias("_r"))

    def _move_bias(self, bias: list, sums: dict, step: int) -> list:
        """(value, m, v) of every class after the step."""
        out = []
        for i, (b, m, v) in enumerate(bias):
            m = FIRST * m + (1 - FIRST) * sums[i]
            v = SECOND * v + (1 - SECOND) * sums[i] ** 2
            b -= self.rate * (m / (1 - FIRST ** step)) / (
                (v / (1 - SECOND ** step)) ** 0.5 + EPSILON)
            out.append((b, m, v))
        return out

    def steps(self, epochs: int) -> Iterator[tuple[int, TopicModel]]:
        """(epoch, model) after each of ``epochs`` epochs."""
        spark = self.rows.sparkSession
        state = [spark.createDataFrame([], STATE)]
        bias = [(0.0, 0.0, 0.0)] * len(self.classes)
        step = 0
        for epoch in range(1, epochs + 1):
            rows, vectors = self._dealt(self.rows, epoch), self._dealt(self.vectors, epoch)
            for batch in range(self.batches):
                mine = F.col("_batch") == batch
                x = vectors.filter(mine)
                known = _latest(state, x.select("analyzer", "term").distinct())
                errors = materialize(self._residuals(
                    rows.filter(mine), x, known.select(*KEY, "w"), [b for b, _, _ in bias]))
                # one row a class
                found = errors.groupBy("class").agg(F.sum("_r").alias("r"),
                                                    F.sum("_share").alias("share")).collect()
                if not found:
                    continue
                step += 1
                share = found[0].share
                bias = self._move_bias(bias, {r["class"]: r.r / share for r in found}, step)
                slopes = x.join(errors, "_id").groupBy(*KEY).agg(
                    (F.sum(F.col("_x") * F.col("_r")) / share).alias("_g"))
                w, m, v = (F.coalesce(c, F.lit(0.0)) for c in ("w", "m", "v"))
                m, v, change = moved(m, v, F.col("_g") + self.l2 * w, step, self.rate)
                state.append(materialize(slopes.join(known, KEY, "left").select(
                    *KEY, (w + change).alias("w"), m.alias("m"), v.alias("v"),
                    F.lit(step).alias("step"))))
                if len(state) > MERGE:
                    state = [materialize(_latest(state))]
            state = [materialize(_latest(state))]
            yield epoch, self._model(state[0], [b for b, _, _ in bias])

    def _model(self, state: DataFrame, bias: list[float]) -> TopicModel:
        arrays = state.groupBy(*KEY[:2]).agg(F.transform(
            F.sort_array(F.collect_list(F.struct("class", "w"))), lambda e: e["w"]).alias("w"))
        unmoved = F.array_repeat(F.lit(0.0), len(self.classes))
        terms = self.vectorizer.vocabulary.join(arrays, KEY[:2], "left").withColumn(
            "w", F.coalesce("w", unmoved))
        return TopicModel(tuple(self.vectorizer.blocks), self.vectorizer.n_docs,
                          materialize(terms), self.classes, bias)

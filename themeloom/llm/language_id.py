"""Language of a text in two steps: the family, then the language inside it.

Texts become hashed counts of letter runs: bytes of one to four letters with word edges, square
roots, unit length.  A linear support vector machine for each family against the rest gives the
family; inside it, one machine for each pair of languages votes, and margins settle ties.  All
machines are fitted in parallel tasks, by dual coordinate descent on a sample of at most
``per_language`` texts of a language and ``most_texts`` in all: a documented bound, so a task's
memory doesn't grow with the table.  Every row is predicted from its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without a
language or doc_id don't train; a language without a known family is a family of its own; without
training rows everything is ``und``; one language alone is always predicted; equal texts get equal
results; an empty table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.scan import text_bytes
from themeloom.llm.tables import documents, query, remainder, slices
from themeloom.session import materialize

BUCKETS = 4096
RUNS = (1, 2, 3, 4)
PER_LANGUAGE = 500
MOST_TEXTS = 8_000
PASSES = 15
COST = 1.0
SEED = 7
UNKNOWN = "und"

# Families of languages by their usual codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

# Letters in lower case, bytes of other scripts as they are, everything else between words.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """A row of unit length (or zeros) for each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    if not len(data):
        return np.zeros((n, BUCKETS), dtype=np.float32)
    points = _LETTERS[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.zeros(n * BUCKETS)
    value = np.zeros(len(points), dtype=np.uint32)
    blank = points == 32
    for size in range(1, max(RUNS) + 1):
        # the run of this size that begins at each byte; a blank may only begin or end it
        m = len(points) - size + 1
        if m <= 0:
            break
        value = (value[:m] * np.uint32(0x01000193)) ^ points[size - 1:]
        inside = owner[:m] == owner[size - 1:]
        if size > 2:
            inner = blank[1:m + 1].copy()
            for j in range(2, size - 1):
                inner |= blank[j:j + m]
            inside &= ~inner
        if size == 1:
            inside &= ~blank
        elif size == 2:
            inside &= ~(blank[:m] & blank[1:])
        if size in RUNS:
            mixed = (value + np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            cell = owner[:m][inside] * BUCKETS + (mixed[inside] >> np.uint32(20)).astype(np.int64)
            counts += np.bincount(cell, minlength=n * BUCKETS)
    x = np.sqrt(counts.reshape(n, BUCKETS))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm == 0, 1, norm)).astype(np.float32)


def support_vector(x: np.ndarray, y: np.ndarray, passes: int = PASSES,
                   cost: float = COST) -> np.ndarray:
    """Weights (and a constant) of a linear machine with squared hinge loss; y is -1 or 1.

    Both kinds weigh the same in sum.
    """
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    slack = 0.5 / (cost * weight)
    square = (x * x).sum(1) + slack
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    draw = np.random.default_rng(SEED)
    for _ in range(passes):
        most = 0.0
        for i in draw.permutation(len(x)).tolist():
            step = (1 - y[i] * (x[i] @ w) - slack[i] * alpha[i]) / square[i]
            new = max(alpha[i] + step, 0.0)
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def sample(docs: DataFrame, per_language: int, most_texts: int) -> DataFrame:
    """(lang, text) of at most so many rows of each language, by a hash of their ids.

    With more than ``most_texts`` languages, those with the most rows.
    """
    counts = materialize(docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(
        most_texts))
    quota = max(1, min(per_language, most_texts // max(counts.count(), 1)))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    # no more rows than most_texts, so texts needn't be shuffled for it
    thin = docs.join(F.broadcast(counts), "lang").filter(chance * F.col("count") <= 2 * quota + 50)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "text")
    return thin.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= quota).select(
        "lang", "text")


class LanguageModel:
    """Families, languages, and the weights of their machines."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs = langs
        self.families: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            self.families.setdefault(family_of(lang), []).append(i)
        names = list(self.families)
        flat = np.zeros(BUCKETS + 1)
        self.top = np.array([weights.get(f"family {f}", flat) for f in names]).reshape(
            len(names), -1)
        self.pairs = {f: [(a, b, weights.get(f"pair {langs[a]} {langs[b]}", flat))
                          for a, b in combinations(ids, 2)] for f, ids in self.families.items()}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1 for each row."""
        margins = x @ self.top[:, :-1].T + self.top[:, -1]
        best = margins.argmax(1)
        spread = np.exp(2 * (margins - margins.max(1, keepdims=True)))
        sure = spread[np.arange(len(x)), best] / spread.sum(1)
        out, score = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for k, (family, ids) in enumerate(self.families.items()):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            place = {lang: j for j, lang in enumerate(ids)}
            votes, margin = np.zeros((len(rows), len(ids))), np.zeros((len(rows), len(ids)))
            for a, b, w in self.pairs[family]:
                m = x[rows] @ w[:-1] + w[-1]
                chance = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
                votes[:, place[a]] += m >= 0
                votes[:, place[b]] += m < 0
                margin[:, place[a]] += chance
                margin[:, place[b]] += 1 - chance
            total = votes + margin / (len(ids) + 1)
            won = total.argmax(1)
            out[rows] = np.array(ids)[won]
            share = margin[np.arange(len(rows)), won] / max(len(ids) - 1, 1)
            score[rows] = sure[rows] * (share if len(ids) > 1 else 1.0)
        return out, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE,
        most_texts: int = MOST_TEXTS) -> LanguageModel | None:
    """A model from (doc_id, text, lang), or None without rows."""
    rows = materialize(sample(docs, per_language, most_texts))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    families = sorted({family_of(x) for x in langs})
    jobs = [(f"family {f}", x, 1 if family_of(x) == f else -1)
            for f in families if len(families) > 1 for x in langs]
    for a, b in combinations(langs, 2):
        if family_of(a) == family_of(b):
            jobs += [(f"pair {a} {b}", a, 1), (f"pair {a} {b}", b, -1)]
    if not jobs:
        return LanguageModel(langs, {})
    plan = docs.sparkSession.createDataFrame(jobs, "machine string, lang string, side int")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pa.RecordBatch.from_pandas(pdf[["text"]].sort_values("text"), preserve_index=False)
        sides = pdf.sort_values("text")["side"].to_numpy().astype(float)
        x = np.concatenate([features(p.column("text")) for p in slices(parts, "text", 1 << 20, 512)])
        return pd.DataFrame({"machine": [pdf["machine"].iloc[0]],
                             "w": [support_vector(x, sides).tolist()]})

    fitted = rows.join(plan, "lang").groupBy("machine").applyInPandas(
        train, "machine string, w array<double>").collect()
    return LanguageModel(langs, {r.machine: np.array(r.w) for r in fitted})


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, 512):
                lettered = part.column("lettered").to_numpy(zero_copy_only=False)
                if model is None:
                    name, score = np.full(len(lettered), UNKNOWN, dtype=object), lettered * 0.0
                else:
                    index, score = model.predict(features(part.column("text")))
                    name = np.where(lettered, np.array(model.langs, dtype=object)[index], UNKNOWN)
                    score = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(name, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       text.rlike(r"\p{L}").alias("lettered")).mapInArrow(
        scan, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, train: Column, **bounds) -> DataFrame:
    """Predicted language of every row; learns from rows with a language where ``train`` holds."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return predict(docs, fit(known, **bounds))


@query
def op7_language_id(spark, sf_dir):
    """Language of every document; a fifth of the ids is held out."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    train = F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    found = identify(documents(spark, sf_dir), train)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

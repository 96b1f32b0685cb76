"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a row of statistics (lengths, shares of character kinds, repetition, entropy).
Random Fourier features turn them into a fixed number of cosines whose products approximate a
Gaussian kernel.  Ridge weights solve normal equations that tasks sum over their own rows, for each
fold apart, and that Spark adds up cell by cell: the driver gets one matrix per fold, whose size is
fixed by ``features``.  Scores of rows by the weights of the other folds are counted in bins, and
pooling adjacent violators over the bins gives the isotonic map from raw score to probability.

Defined results: null texts count as empty, and empty ones have the statistics of an empty text;
rows without a label, a null label or doc_id don't train; several labels of one id train by their
mean; without any label every score is 0.5, with labels of one kind all scores are that kind; equal
texts get equal scores; repeated rows are scored row by row; an empty table gives an empty result;
only doc_id, text and the label are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.scan import BETWEEN_WORDS, text_bytes
from themeloom.llm.tables import by_id, documents, keyed_texts, query, remainder
from themeloom.session import materialize

FEATURES = 256
FOLDS = 3
BINS = 1024
RIDGE = (1e-4, 1e-3, 1e-2, 1e-1)
SEED = 20
# Raw scores from -1/2 to 3/2 are binned.
LOW, HIGH = -0.5, 1.5
CLIP = 4.0

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "log_line", "upper", "digit", "space",
    "high", "stop", "comma", "pipe", "shout", "symbol", "mark", "distinct_words",
    "distinct_pairs", "distinct_lines", "commonest", "short", "capitals", "marked_end", "entropy",
    "squeeze",
)

_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True


def statistics(raw: bytes) -> list[float]:
    """Statistics of a UTF-8 text, by the names in ``STATISTICS``."""
    data = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    n = max(len(raw), 1)
    chars = len(raw) - int(counts[128:192].sum())
    found = raw.split()
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    w = max(len(found), 1)
    kinds = Counter(found)
    pairs = len(set(zip(found, found[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    marked = int(np.count_nonzero(_MARK[data[:-1]] & BETWEEN_WORDS[data[1:]]))
    marked += bool(len(raw)) and bool(_MARK[data[-1]])
    digits = int(counts[48:58].sum())
    upper = int(counts[65:91].sum())
    lower = int(counts[97:123].sum())
    space = int(counts[32]) + int(counts[9:14].sum())
    high = int(counts[128:].sum())
    stop, comma, pipe, shout = (int(counts[c]) for c in b".,|!")
    symbol = sum(int(counts[c]) for c in b"#$%&*@^~<>{}[]\\_=+")
    mark = len(raw) - digits - upper - lower - space - high - symbol - stop - comma - pipe - shout
    return [
        np.log1p(chars), np.log1p(len(found)), lengths.mean() if len(found) else 0.0,
        lengths.std() if len(found) else 0.0, np.log1p(chars / max(len(lines), 1)),
        upper / max(upper + lower, 1), digits / n, space / n, high / n, 10 * stop / n,
        10 * comma / n, np.sqrt(pipe / n), np.sqrt(shout / n), np.sqrt(symbol / n),
        np.sqrt(mark / n), len(kinds) / w, pairs / max(len(found) - 1, 1),
        len(set(lines)) / max(len(lines), 1), max(kinds.values(), default=0) / w,
        float((lengths <= 3).mean()) if len(found) else 0.0,
        sum(map(bytes.isupper, found)) / w, marked / w,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(raw, 1)) / (n + 20),
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): an array of statistics for every row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            x = np.array([statistics(raw[a:b]) for a, b in zip(at, at[1:], strict=False)],
                         dtype=np.float64).reshape(-1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * len(STATISTICS), pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return keyed_texts(docs).mapInArrow(scan, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))


class Cosines:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES,
                 seed: int = SEED):
        draw = np.random.default_rng(seed)
        p = len(mean)
        self.mean, self.spread = mean, spread
        self.weights = draw.normal(size=(p, features)) / np.sqrt(p)
        self.phase = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        cosines = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.column_stack([cosines, np.ones(len(x))])


def pool_violators(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic means of bins with so many positive rows of a total; empty bins follow the others."""
    blocks: list[list[float]] = []  # positive, total, bins
    for a, n in zip(positive.tolist(), total.tolist(), strict=True):
        blocks.append([a, n, 1])
        while len(blocks) > 1 and (
                blocks[-1][1] == 0 or blocks[-2][1] == 0
                or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            a2, n2, k2 = blocks.pop()
            blocks[-1][0] += a2
            blocks[-1][1] += n2
            blocks[-1][2] += k2
    return np.concatenate([np.full(int(k), a / n if n else 0.5) for a, n, k in blocks])


def ridge(grams: np.ndarray, sums: np.ndarray, squares: np.ndarray, counts: np.ndarray,
          grid=RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights for all folds together, and those that leave each fold out, by the best penalty.

    ``grams[f]`` is the sum of z z' over fold f, ``sums[f]`` of z y, ``squares[f]`` of y y.
    """
    size = grams.shape[1]
    penalty = np.eye(size)
    penalty[-1, -1] = 1e-9

    def solved(a, b, n, share):
        return np.linalg.solve(a + share * max(n, 1) * penalty / size, b)

    best = None
    for share in grid:
        without = [solved(grams.sum(0) - g, sums.sum(0) - b, counts.sum() - n, share)
                   for g, b, n in zip(grams, sums, counts, strict=True)]
        error = sum(s - 2 * w @ b + w @ g @ w
                    for w, g, b, s in zip(without, grams, sums, squares, strict=True))
        if best is None or error < best[0]:
            best = error, share, np.array(without)
    return solved(grams.sum(0), sums.sum(0), counts.sum(), best[1]), best[2]


class QualityModel:
    """A fitted scorer; ``weights`` is None where no labels were given."""

    def __init__(self, cosines=None, weights=None, curve=None):
        self.cosines, self.weights, self.curve = cosines, weights, curve

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.cosines(x) @ self.weights
        centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        return np.clip(np.interp(raw, centres, self.curve), 0.0, 1.0)


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def fit(rows: DataFrame, features: int = FEATURES, folds: int = FOLDS) -> QualityModel:
    """Fit on all of ``rows``: (doc_id, x, y), y from 0 to 1."""
    p = len(STATISTICS)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    rows = materialize(rows.select("x", "y", fold.alias("fold")))
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return QualityModel()
    mean, spread = np.zeros(p), np.ones(p)
    for r in moments:
        mean[r.i], spread[r.i] = r.m, r.s if r.s > 1e-9 else 1.0
    cosines = Cosines(mean, spread, features)
    size = features + 1
    width = size * (size + 1) + 2

    def normal(batches):
        total = np.zeros((folds, width))
        for batch in batches:
            y = batch.column("y").to_numpy()
            part = batch.column("fold").to_numpy()
            z = cosines(_matrix(batch))
            for f in range(folds):
                a, b = z[part == f], y[part == f]
                total[f] += np.concatenate([(a.T @ a).ravel(), a.T @ b, [b @ b, len(b)]])
        for f in np.flatnonzero(total[:, -1]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(f * width + np.arange(width)), pa.array(total[f])],
                names=["cell", "v"])

    cells = (rows.mapInArrow(normal, "cell long, v double").groupBy("cell")
             .agg(F.sum("v").alias("v")).toPandas())
    total = np.zeros(folds * width)
    total[cells.cell.to_numpy()] = cells.v.to_numpy()
    total = total.reshape(folds, width)
    grams = total[:, :size * size].reshape(folds, size, size)
    weights, without = ridge(grams, total[:, size * size:-2], total[:, -2], total[:, -1])

    def count(batches):
        seen = np.zeros((2, BINS))
        for batch in batches:
            z = cosines(_matrix(batch))
            bins = _bins((z * without[batch.column("fold").to_numpy()]).sum(1))
            seen[0] += np.bincount(bins, batch.column("y").to_numpy(), BINS)
            seen[1] += np.bincount(bins, minlength=BINS)
        at = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["b", "pos", "n"])

    binned = (rows.mapInArrow(count, "b long, pos double, n double").groupBy("b")
              .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toPandas())
    seen = np.zeros((2, BINS))
    seen[:, binned.b.to_numpy()] = binned[["pos", "n"]].to_numpy().T
    return QualityModel(cosines, weights, pool_violators(*seen))


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``stats`` with a column score in place of x."""
    kept = [c for c in stats.columns if c != "x"]
    fields = ", ".join(f"`{c}` {t}" for c, t in stats.dtypes if c != "x")

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(model.score(_matrix(batch)))],
                names=[*kept, "score"])

    return stats.mapInArrow(scan, f"{fields}, score double")


def labelled(stats: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
            F.avg(F.col(label).cast("double")).alias("y"))
    return stats.join(known, "doc_id").select("doc_id", "x", "y")


def quality(docs: DataFrame, labels: DataFrame, train: Column | None = None,
            label: str = "quality") -> DataFrame:
    """(doc_id, score) for every row; learns from labelled rows for which ``train`` holds."""
    stats = materialize(text_statistics(docs))
    rows = stats if train is None else stats.filter(train)
    return score(stats, fit(labelled(rows, labels, label)))


def held_out(modulus: int = 3, value: int = 1) -> Column:
    """Rows whose id has this crc32 remainder don't train."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == value, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``; rows without a doc_id are kept."""
    bad = quality(docs, labels, ~held_out()).filter(F.col("score") < least).select("doc_id")
    return by_id(docs, bad.distinct(), "left_anti")


@query
def op1_quality_classifier(spark, sf_dir):
    """Score every document for quality; two thirds of the ids can train."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality(docs, labels, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred fit list.

Entries are put on a grid, x = floor(64 c) + 1,000,000, so that counts, sums and deviations are
exact integers.  The fit list holds each distinct x vector once; X is that list less its means.  A
step multiplies X by a right vector and the rows' results by the transpose of X, in one pass over
the list, summed by task and by dimension.  New vectors are made orthogonal to all earlier ones on
both sides.  A left vector has an entry for every row; it is kept as its coefficients (u = X y), so
no column is stored and earlier left vectors meet a new one through X'u, which is of the size of a
vector.  The singular values of the small bidiagonal matrix give the deviations along the
components, its right vectors the components.

Steps end when the wanted components have converged.  They are then set aside and a new random start
looks for greater ones beside them, as one start sees only one direction of a repeated value; the
work ends when a start finds none, or when there are as many vectors as dimensions.

Defined results: rows are dropped if the vector is null or holds a null, a NaN, an infinity or an
entry of 2^56 or more, which has no place on the grid; vectors shorter than the longest count as
ending in zeros; a component without spread (below 1e-7 of the length of X, as of a rank below the
number wanted) has no row, so one distinct vector, vectors without entries and an empty table give
an empty result; equal eigenvalues have some orthonormal components of their space; rows without an
id or with a repeated one have results of their own; a ``deviation`` beyond 64 bits is null.  Only
the id and the vector are read, texts of any length are not.  The driver holds three arrays of the width of a vector for each step.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.tables import query
from themeloom.session import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SEED = 42
# Of the length of all of X: residuals below TINY are rounding, and so are lengths of left vectors
# below FLAT, as those come from squares.
TINY, FLAT = 1e-14, 1e-7
# Rows of the fit list that are stored side by side, and rows of results made at once.
BLOCK = 4096
LARGEST = 2.0 ** 56

Product = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Whitening(NamedTuple):
    """Grid means less the offset, components (rows), eigenvalues, and what describes the fit."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def on_grid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): grid entries less the offset, of rows that have them."""
    entries = F.col(vec_col)
    fits = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    return vectors.filter(entries.isNotNull() & fits).select(
        F.col(id_col).alias("id"),
        F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def _padded(rows: DataFrame, width: int) -> DataFrame:
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.concat("x", missing))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def fit_list(rows: DataFrame, width: int, largest: int) -> tuple[DataFrame, type]:
    """Each distinct vector once, as blocks (data) of the least integers that hold the entries.

    Also the type of these integers.
    """
    kind = next(k for k in (np.int16, np.int32, np.int64) if largest <= np.iinfo(k).max)

    def pack(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i:i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)],
                          pa.binary())], names=["data"])

    distinct = rows.select("x").distinct()
    return materialize(distinct.mapInArrow(pack, "data binary")), kind


def summed(blocks: DataFrame, kind: type, width: int,
           part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the array that ``part`` makes of a block's rows."""
    def scan(batches):
        total = 0
        for batch in batches:
            for block in batch.column("data"):
                total = total + part(np.frombuffer(block.as_buffer(), kind).reshape(-1, width))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    cells = blocks.mapInArrow(scan, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    rows = cells.collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.v
    return out


def _clear(r: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        r = r - basis.T @ (basis @ r)
    return r


def _search(product: Product, width: int, wanted: int, length: float, draw: np.random.Generator,
            values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bidiagonalise from a random start beside the components known so far.

    Gives the greatest ``wanted`` singular values and right vectors of the known and the found ones,
    and whether there can be none that is greater.
    """
    known = len(values)
    right = list(vectors)
    left = [v / s for v, s in zip(vectors, values, strict=True)]            # u = X left
    back = [v * s for v, s in zip(vectors, values, strict=True)]            # X'u
    diagonal, above = [], []
    r = _clear(draw.normal(size=width), np.array(right).reshape(-1, width))
    while True:
        v = r / np.linalg.norm(r)
        y = v.copy()
        if left:
            y -= np.array(left).T @ (np.array(back) @ v)
        square, p = product(y)
        if left:
            g = np.array(left) @ p
            y, p, square = y - np.array(left).T @ g, p - np.array(back).T @ g, square - g @ g
        alpha = np.sqrt(max(square, 0.0))
        small = alpha <= FLAT * length
        right.append(v)
        left.append(np.zeros(width) if small else y / alpha)
        back.append(np.zeros(width) if small else p / alpha)
        diagonal.append(0.0 if small else alpha)
        r = _clear(back[-1] - diagonal[-1] * v, np.array(right))
        beta = np.linalg.norm(r)
        over = small or beta <= TINY * length * max(1.0, length / alpha)
        whole = len(right) == width
        p, s, q = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
        residual = np.zeros(len(s)) if whole or over else beta * np.abs(p[-1])
        both = np.concatenate([values, s])
        best = np.argsort(-both, kind="stable")[:wanted]
        needed = {0, *(best[best >= known] - known).tolist()}
        if all(residual[i] <= TINY * length for i in needed):
            found = q @ np.array(right[known:])
            all_vectors = np.concatenate([vectors.reshape(-1, width), found])
            keep = best[both[best] > FLAT * length]
            done = whole or s[0] <= FLAT * length or bool((best < known).all())
            return both[keep], all_vectors[keep], done
        above.append(beta)


def singular(product: Product, width: int, wanted: int, length: float,
             seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The greatest ``wanted`` singular values of X and their right vectors as rows.

    ``product`` gives |X y|^2 and X'X y; ``length`` is the Frobenius norm of X.
    """
    draw = np.random.default_rng(seed)
    values, vectors, done = np.zeros(0), np.zeros((0, width)), width == 0 or length == 0
    while not done:
        values, vectors, done = _search(product, width, wanted, length, draw, values, vectors)
    return values, vectors


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """Fit on the distinct vectors of ``rows`` (id, x); also the width of the longest vector."""
    shape = rows.agg(F.max(F.size("x")).alias("width"),
                     F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias(
                         "largest")).first()
    width = shape.width or 0
    if not width:
        return None, 0
    blocks, kind = fit_list(_padded(rows, width), width, shape.largest)
    count, sums = _totals(blocks, kind, width)
    means = np.array([s / count for s in sums])

    def length(x):
        return np.array([((x - means) ** 2).sum()])

    square = float(summed(blocks, kind, width, length)[0])

    def product(y):
        def part(x):
            centred = x - means
            u = centred @ y
            return np.append(centred.T @ u, u @ u)
        total = summed(blocks, kind, width, part)
        return float(total[-1]), total[:-1]

    deviations, vectors = singular(product, width, wanted, np.sqrt(square))
    if not len(deviations):
        return None, width
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    values = deviations ** 2 / count
    project = (vectors / np.sqrt(values)[:, None]).T

    def moments(x):
        w = (x - means) @ project
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = summed(blocks, kind, width, moments)
    k = len(values)
    mean = total[:k] / count
    spread = total[k:].reshape(k, k) / count - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(k)).max())
    return Whitening(count, tuple(sums), vectors, values, square / count, error), width


def _totals(blocks: DataFrame, kind: type, width: int) -> tuple[int, list[int]]:
    """Exact number of rows and sums of each dimension."""
    def scan(batches):
        count, total = 0, [0] * width
        for batch in batches:
            for block in batch.column("data"):
                x = np.frombuffer(block.as_buffer(), kind).reshape(-1, width)
                count += len(x)
                high, low = x >> 8, x & 255                 # neither sum can pass 64 bits
                total = [t + 256 * int(a) + int(b) for t, a, b in zip(
                    total, high.sum(0, dtype=np.int64), low.sum(0, dtype=np.int64), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width + 1)), pa.array([str(t) for t in (*total, count)])],
            names=["i", "v"])

    rows = blocks.mapInArrow(scan, "i long, v string").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return found[width], [found[i] for i in range(width)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           wanted: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each component.

    ``whitened`` is the place of the row's vector, less the mean, along the component, over the
    component's deviation.  ``deviation`` is the sum of (n x - S)^2 over dimensions.
    """
    name, kind = id_col, dict(vectors.dtypes)[id_col]
    rows = on_grid(vectors, id_col, vec_col)
    model, width = fit(rows, wanted)
    schema = (f"id {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", name)
    n, k = model.n, len(model.values)
    means = np.array([s / n for s in model.sums])
    project = (model.vectors / np.sqrt(model.values)[:, None]).T
    explained = model.values / model.trace

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, n)),
                     pa.array(exact_deviations(x, n, model.sums), pa.int64()).take(
                         pa.array(np.repeat(np.arange(len(x)), k))),
                     pa.array(((x - means) @ project).ravel()),
                     pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(x) * k, model.error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"])

    return _padded(rows, width).mapInArrow(scan, schema).withColumnRenamed("id", name)


def exact_deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row; None beyond 64 bits."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if largest ** 2 * len(sums) < 2 ** 62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
    wide = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(1)
    return [d if d < 2 ** 63 else None for d in wide]


@query
def op11_embedding_whitening(spark, sf_dir):
    """Place of every vector along the 16 components of greatest spread."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

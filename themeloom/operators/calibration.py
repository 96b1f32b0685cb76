"""Temperature scaling: pick the temperature with the lowest mean negative log-likelihood."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.decisions import softmax


def nll(logits: Column, target: Column, temperature: float | Column) -> Column:
    """-log of the probability of the true class (0-based index); 1e-12 keeps it finite."""
    return -F.log(softmax(logits, temperature)[target] + F.lit(1e-12))


def nll_grid(scored: DataFrame, temperatures: Sequence[float], logits: str = "logits",
             target: str = "target") -> DataFrame:
    """(temperature, nll) for all temperatures from one pass over the logits.

    Each row meets every temperature inside its task and is averaged there; only one partial
    average per temperature and task is shuffled.
    """
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    each = scored.select(F.col(logits).alias("_z"), F.col(target).alias("_y"),
                         F.explode(grid).alias("temperature"))
    return each.groupBy("temperature").agg(
        F.avg(nll(F.col("_z"), F.col("_y"), F.col("temperature"))).alias("nll"))


def fit_temperature(scored: DataFrame, low: float = 0.05, high: float = 10.0, points: int = 33,
                    tolerance: float = 1e-9, logits: str = "logits",
                    target: str = "target") -> float:
    """Minimise the likelihood loss over log(temperature) in [low, high].

    The loss has one minimum, so each pass scores a whole grid and keeps the cells around its
    best point: about eight passes over the logits (write them first).  Grid searches need no
    more passes on more data.
    """
    a, b = math.log(low), math.log(high)
    while b - a > tolerance:
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        rows = nll_grid(scored, [math.exp(x) for x in grid], logits, target).collect()
        losses = [r["nll"] for r in sorted(rows, key=lambda r: r["temperature"])]
        best = losses.index(min(losses))
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return math.exp((a + b) / 2)

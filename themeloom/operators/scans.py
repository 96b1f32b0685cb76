"""Aggregates over the earlier slices of a key, taken in levels.

One window over all slices of a key is one task for that key, however many slices it has.  Here
slices are grouped into blocks of ``FAN``, blocks into blocks of blocks; a window only ever spans
the members of one block, and each level adds what its block's predecessors hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAN = 1_024
LEVELS = 3

# How two partial results combine; a null one counts for nothing.
_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}


def over_earlier(cells: DataFrame, keys: Sequence[str], index: str, value: str, how: str, name: str,
                 backward: bool = False, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """``cells`` with ``name``: ``how`` ("sum", "min", "max") of the values of earlier cells.

    ``cells`` has one row per key and whole number ``index``; ``backward`` takes the later cells
    instead.  Null where there are none.  With indexes that span ``fan`` ** ``levels`` at most, no
    window holds more than ``fan`` rows.
    """
    total = getattr(F, how)
    order = F.col(index).desc() if backward else F.col(index).asc()
    frame = (Window.unboundedPreceding, -1)
    if levels == 1:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(*frame)
        return cells.withColumn(name, total(value).over(whole))
    block = f"_b{levels}"
    placed = cells.withColumn(block, F.floor(F.col(index) / fan))
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(*frame)
    blocks = placed.groupBy(*keys, block).agg(total(value).alias("_v"))
    outer = over_earlier(blocks, keys, block, "_v", how, "_outer", backward, levels - 1, fan)
    outer = outer.filter(F.col("_outer").isNotNull()).select(*keys, block, "_outer")
    joined = placed.withColumn("_inner", total(value).over(inside)).join(
        outer, [*keys, block], "left")
    merged = _MERGE[how](F.col("_inner"), F.col("_outer"))
    return joined.select(*cells.columns, merged.alias(name))

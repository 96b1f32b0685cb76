"""Seeded orders, and running sums that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom.operators.scans import LEVELS, over_earlier


def seeded_order(seed: int, *keys: Column) -> Column:
    """Repeatable pseudo-random order key that any SQL engine can recompute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def running_total(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column],
                  value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Running sum per key without giving a whole key to one task.

    ``chunk`` is a column that cuts a key into ordered runs (equal or rising with the order).
    Sums run inside (key, chunk); the totals of earlier chunks come from a table with one row per
    chunk, summed in levels where chunks are whole numbers.  Keys that fit one chunk need nothing from that table, so it stays small enough for
    adaptive execution to broadcast unless there really are long keys.
    """
    last = 0 if inclusive else -1
    inner = (Window.partitionBy(*keys, chunk).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, last))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_chunk_total"))
    # Chunks that aren't numbers can't be grouped in levels; a prefix of a hash has few values.
    levels = LEVELS if dict(df.dtypes)[chunk] in ("int", "bigint") else 1
    offsets = over_earlier(totals, keys, chunk, "_chunk_total", "sum", "_before", levels=levels)
    offsets = offsets.drop("_chunk_total").filter(F.coalesce("_before", F.lit(0)) != 0)
    return (local.join(offsets, [*keys, chunk], "left")
            .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
            .drop("_local", "_before"))

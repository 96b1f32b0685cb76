"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.session import materialize

# Links that a task takes together, before the nodes of a round meet.
LOCAL = 1 << 14


def stars(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these links, but the least of its component, linked to that least one."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[:len(src)], at[len(src):]
    root = np.arange(len(nodes))
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while not np.array_equal(root, up := root[root]):
            root = up
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of ``LOCAL`` at a time as stars, which link the same nodes."""
    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst = stars(*(np.concatenate([b.column(c).to_numpy() for b in held])
                           for c in ("src", "dst")))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, LOCAL):
            part = batch.slice(at, LOCAL)
            if size + part.num_rows > LOCAL:
                yield made(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if held:
        yield made(held)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one lesser node at most, and that one to none."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"),
                                         F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 or up + down > 1").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst); the root is the least node reached.

    Each round first makes stars of the links that lie together, a bounded number at a time, so
    that long chains are short from the first round on.  Then it links the greater neighbours of a
    node to the least of all, then the lesser ones, and writes the links; rounds end when all links
    are stars.  They grow with the logarithm of the longest chain.  Minima combine before the shuffle
    and joins on a much-linked node can be split, so no node needs all its neighbours in one task.
    """
    edges = materialize(edges.filter("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while links := edges.count():
        parts = -(-links // LOCAL)
        edges = edges.coalesce(parts).mapInArrow(_starred, edges.schema)
        if parts == 1:      # LOCAL links at most: they were all taken together
            edges = materialize(edges)
            break
        # stars of two parts may have the same link
        edges = materialize(edges.distinct())
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("least"))
        large = both.join(least, "src").filter("dst > src").select(
            F.col("dst").alias("src"), F.least("src", "least").alias("dst"))
        large = materialize(large.filter("src <> dst").distinct())
        least = large.groupBy("src").agg(F.min("dst").alias("least"))
        small = large.join(least, "src").select(
            F.when(F.col("dst") == F.col("least"), F.col("src")).otherwise(
                F.col("dst")).alias("src"), F.col("least").alias("dst"))
        edges = materialize(small.filter("src <> dst").distinct())
        if _is_stars(edges):
            break
    nodes = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return nodes.unionByName(edges.select(F.col("dst").alias("node"),
                                          F.col("dst").alias("root")).distinct())

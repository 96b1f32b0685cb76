"""Even shards by sampled splitters and range partitioning, in DataFrame functions alone.

Rows are ordered by a hash of their text, then of their id, then by row, so that equal texts are
neighbours and still can be parted.  A sample in which a row's chance follows its size gives the
splitters: every so many draws one, counted inside stretches of the order.  Splitters cut the order
into ranges; a range that turned out larger than its share is subdivided, and so are the rows of one
text that are larger than that by themselves: many short copies fill no range by their bytes.  The sizes of the ranges give each the place where it begins,
and running sums inside the ranges give every row its place in the whole; equal stretches of the
whole are the shards.  Rows of equal text go with the
middle of them all, unless they fill more than a hundredth of a shard.  So shard sizes differ by no
more than the rows, or small groups of equal texts, at their ends, and no task sorts more than a
range.

The law is ``bytes``: sizes near equal.  Defined results: null texts have size 8 and crc32 0 (that
of no bytes); repeated rows are dealt row by row; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.tables import documents, query
from themeloom.session import materialize

SHARDS = 24
ROW_OVERHEAD = 8
RANGE_ROWS = 200_000
RANGES_PER_SHARD = 4
DRAWS = 32  # of each range
# Equal texts are parted only if they fill more than this share of a shard.
TOGETHER = 0.01
BINS = 1024  # of the order's first key; splitters are looked up inside a bin
SEED = 9


def keyed(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and order keys; texts are left behind."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("k2"),
        F.monotonically_increasing_id().alias("row"))


def _bin() -> Column:
    width = 64 - (BINS - 1).bit_length()
    return (F.shiftright("k1", width) + BINS // 2).cast("int")


def splitters(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """(bin, before, keys) for each bin: splitters in lower bins, and its own in order.

    The sample has about ``ranges * DRAWS`` rows whatever the table's size.
    """
    chance = F.pmod(F.xxhash64(F.col("row"), F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    share = F.col("size") * F.lit(ranges * DRAWS / total)
    drawn = materialize(rows.filter(chance < share).select(_bin().alias("bin"), "k1", "k2", "row"))
    lower = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = drawn.groupBy("bin").agg(F.count("*").alias("n")).select(
        "bin", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("ahead"))  # a row for each bin
    order = Window.partitionBy("bin").orderBy("k1", "k2", "row")
    chosen = drawn.withColumn("n", F.row_number().over(order)).join(ahead, "bin").filter(
        (F.col("n") + F.col("ahead")) % DRAWS == 0)
    own = chosen.groupBy("bin").agg(
        F.sort_array(F.collect_list(F.struct("k1", "k2", "row"))).alias("keys"))
    bins = rows.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin")).join(
        own, "bin", "left")
    n = F.coalesce(F.size("keys"), F.lit(0))
    count = F.when(F.col("keys").isNull(), 0).otherwise(n)
    return bins.withColumn("count", count).select(
        "bin", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("before"), "keys", "count")


def _not_above(steps: int) -> Column:
    """Number of the bin's splitters that aren't above a row's key, by bisection."""
    key = F.struct("k1", "k2", "row")
    span = F.struct(F.lit(0).alias("lo"), F.col("count").cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(
            F.get(F.col("keys"), middle) <= key,
            F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
                F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve, lambda s: s["lo"])


def ranged(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """``rows`` with their range, and the part of it where the range is overfull.

    Parts follow the text's hash.  A text that overfills a range by itself is ``hot``: its rows come
    after the others of their part, dealt out evenly to ``piece``, and carry its ``hot_bytes``.
    """
    cuts = splitters(rows, ranges, total)
    found = rows.withColumn("bin", _bin()).join(cuts, "bin").withColumn(
        "range", F.col("before") + _not_above(ranges.bit_length() + 1)).drop(
            "bin", "before", "keys", "count")
    found = materialize(found)
    share = total / ranges
    parts = F.greatest(F.ceil(F.col("bytes") / F.lit(2 * share)),
                       F.ceil(F.col("n") / F.lit(2 * RANGE_ROWS)), F.lit(1))
    full = found.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"),
        F.min("k1").cast("double").alias("least"), F.max("k1").cast("double").alias("most"))
    full = materialize(full.select("range", parts.cast("int").alias("parts"), "least", "most")
                       .filter("parts > 1"))
    # only rows of overfull ranges are counted by text
    hot = found.join(full.select("range"), "range", "left_semi").groupBy("range", "k1").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"))
    hot = hot.select("range", "k1", F.col("bytes").alias("hot_bytes"),
                     parts.cast("int").alias("pieces")).filter("pieces > 1")
    # the place of a hash between the least and the most of its range, which parts texts evenly
    place = (F.col("k1") - F.col("least")) / (F.col("most") - F.col("least"))
    part = F.when(F.col("least") < F.col("most"), F.least(
        F.floor(place * F.col("parts")), F.col("parts") - 1)).cast("int")
    piece = F.pmod(F.xxhash64("row", F.lit(SEED + 1)), F.col("pieces")).cast("int")
    return found.join(full, "range", "left").join(hot, ["range", "k1"], "left").withColumns({
        "part": F.coalesce(part, F.lit(0)), "piece": F.coalesce(piece, F.lit(0)),
        "hot": F.when(F.col("pieces").isNotNull(), F.col("k1"))}).drop(
            "parts", "least", "most", "pieces")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row with its shard and its place in the shard."""
    rows = materialize(keyed(docs))
    whole = rows.agg(F.sum("size"), F.count("*")).first()
    total, n = whole[0] or 1, whole[1]
    ranges = max(RANGES_PER_SHARD * shards, -(-n // RANGE_ROWS))
    rows = materialize(ranged(rows, ranges, total))
    cell = ["range", "part", "hot", "piece"]  # rows without a hot text come first
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("range", "part", "hot")
    cells = rows.groupBy(*cell).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
            *cell, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n")).withColumn(
                "begin", F.min("bytes").over(same))
    cells = cells.select(*[F.col(c).alias(f"c_{c}") for c in cell], "bytes", "n", "begin")
    order = Window.partitionBy(*cell).orderBy("k1", "k2", "row")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = F.lit(True)
    for c in cell:
        at = at & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    placed = rows.withColumn("upto", inside).withColumn(
        "rank", F.row_number().over(order)).join(cells, at)
    # equal texts stay together by the middle of them all, unless they are too much for that
    equal = Window.partitionBy(*cell, "k1")
    own = F.coalesce(F.col("hot_bytes"), F.sum("size").over(equal))
    end = F.when(F.col("hot").isNull(), F.max("upto").over(equal)).otherwise(
        F.col("begin") - F.col("bytes") + F.col("hot_bytes"))
    middle = F.when(own <= F.lit(int(total / shards * TOGETHER)),
                    end - F.floor(own / 2)).otherwise(
                        F.col("upto") - F.floor(F.col("size") / 2))
    number = F.expr(f"cast(least({shards - 1}, ((bytes + middle) * {shards}) div {total}) as int)")
    placed = placed.withColumn("middle", middle.cast("long") - 1)
    placed = materialize(placed.select(
        "doc_id", "size", "text_crc32", number.alias("shard"),
        (F.col("n") + F.col("rank") - 1).alias("rank")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_sampled_splitters(spark, sf_dir):
    """All documents in 24 shards of near equal size."""
    return shard(documents(spark, sf_dir))

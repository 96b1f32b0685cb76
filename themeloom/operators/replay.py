"""Replaying time rules over a log: result cache with a lifetime, cooldown after a failure.

Both rules are the same chain.  An *anchor* (a cache miss, an offline answer) rules the time that
follows it; the next anchor is the first later event the last one no longer covers.  Each event's
successor is found by time slices and the chain from the first event is followed by pointer
doubling, so the work of one key is spread over the cluster and takes log2(chain length) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from themeloom import constants as K
from themeloom.operators.scans import over_earlier
from themeloom.session import materialize

SLICES_PER_GAP = 64


def anchors(events: DataFrame, gap_us: int, strict: bool) -> DataFrame:
    """(key, t, id) of the chain from events (key, t in microseconds, id).

    The next anchor is the first event later than ``t + gap`` (``strict``) or not before it.
    """
    return chain(events.withColumn("reach", F.lit(gap_us + (1 if strict else 0))), gap_us)


def chain(events: DataFrame, gap_us: int) -> DataFrame:
    """(key, t, id) of the chain from events (key, t, id, reach).

    It begins with the first event of a key; the next is the first at ``t + reach`` or later, and of
    equal times the one of least id.  ``gap_us`` is the usual least reach: slices are parts of it.
    """
    first = F.min(F.struct("id", "reach")).alias("_least")
    times = materialize(events.groupBy("key", "t").agg(first).select("key", "t", "_least.*"))
    jumps = materialize(_successors(times, max(gap_us // SLICES_PER_GAP, 1)).filter(
        F.col("next").isNotNull()))
    reached = materialize(times.groupBy("key").agg(F.min("t").alias("t")))
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["key", "t"]).select("key", F.col("next").alias("t"))
        reached = materialize(reached.unionByName(ahead).distinct())
        second = jumps.select("key", F.col("t").alias("next"), F.col("next").alias("_far"))
        jumps = materialize(jumps.join(second, ["key", "next"]).select(
            "key", "t", F.col("_far").alias("next")))
    return reached.join(times, ["key", "t"]).select("key", "t", "id")


def _uncovered(t: Column, last: Column, gap_us: int, strict: bool) -> Column:
    return (t - last > gap_us) if strict else (t - last >= gap_us)


def _successors(times: DataFrame, width: int) -> DataFrame:
    """(key, t, next): first event of the key at t + reach or later."""
    marks = times.select("key", F.col("t").alias("_x"), F.col("t").alias("_event"),
                         F.lit(None).cast("long").alias("_from"))
    probes = times.select("key", (F.col("t") + F.col("reach")).alias("_x"),
                          F.lit(None).cast("long").alias("_event"), F.col("t").alias("_from"))
    both = marks.unionByName(probes).withColumn("_slice", F.floor(F.col("_x") / width))
    # Inside a slice: the nearest event at or after the probe (events sort after equal probes).
    ahead = (Window.partitionBy("key", "_slice").orderBy("_x", F.col("_event").isNotNull())
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.withColumn("_near", F.min("_event").over(ahead)).filter(
        F.col("_from").isNotNull())
    # Otherwise the first event of the next slice that has one.
    firsts = both.groupBy("key", "_slice").agg(F.min("_event").alias("_first"))
    following = over_earlier(firsts, ["key"], "_slice", "_first", "min", "_later", backward=True)
    return near.join(following.drop("_first"), ["key", "_slice"]).select(
        "key", F.col("_from").alias("t"), F.coalesce("_near", "_later").alias("next"))


def covered_events(events: DataFrame, chain: DataFrame, gap_us: int, strict: bool) -> DataFrame:
    """Events with the anchor that covers them (``_a``, ``_aid``), null where none does.

    Anchors are more than a gap apart, so at most two can cover a slice as wide as the gap.
    """
    place = F.floor(F.col("t") / max(gap_us, 1))
    slices = chain.select("key", F.col("t").alias("_a"), F.col("id").alias("_aid"),
                          F.explode(F.array(place, place + 1)).alias("_slice"))
    placed = events.withColumn("_slice", place)
    e, c = placed.alias("e"), slices.alias("c")
    inside = (F.col("e.t") >= F.col("c._a")) & ~_uncovered(
        F.col("e.t"), F.col("c._a"), gap_us, strict)
    return e.join(c, (F.col("e.key") == F.col("c.key"))
                  & (F.col("e._slice") == F.col("c._slice")) & inside, "left").select(
        "e.*", "c._a", "c._aid").drop("_slice")


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time column with or without a time zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"),
                                F.col(ts))
    return F.unix_micros(ts)


def _as_events(df: DataFrame, key: str, ts: str, id_col: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), micros(df, ts).alias("t"),
                     F.col(id_col).alias("id"))


def replay_cache(log: DataFrame, key: str, ts: str, id_col: str,
                 ttl_hours: float = K.CACHE_TTL_HOURS) -> DataFrame:
    """(id, key, hit, cached_us): each lookup of an ordered query log against its cache.

    A miss stores the result; a hit leaves the stamp; an entry is stale once older than the
    lifetime.
    """
    gap = int(ttl_hours * 3_600_000_000)
    events = _as_events(log, key, ts, id_col)
    covered = covered_events(events, anchors(events, gap, True), gap, True)
    miss = (F.col("t") == F.col("_a")) & (F.col("id") == F.col("_aid"))
    return covered.select(F.col("id").alias(id_col), F.col("key").alias(key),
                          (~miss).alias("hit"), F.col("_a").alias("cached_us"))


def apply_cooldown(attempts: DataFrame, key: str, ts: str, id_col: str, failed: Column,
                   cooldown_seconds: float = K.OFFLINE_COOLDOWN_SECONDS) -> DataFrame:
    """(id, key, suppressed): attempts that fall into the pause after a failed one.

    Suppressed attempts are never made, so they neither fail nor lengthen the pause.
    """
    gap = int(cooldown_seconds * 1_000_000)
    failures = _as_events(attempts.filter(failed), key, ts, id_col)
    events = _as_events(attempts, key, ts, id_col)
    covered = covered_events(events, anchors(failures, gap, False), gap, False)
    after = F.col("_a").isNotNull() & ((F.col("t") > F.col("_a")) | (F.col("id") > F.col("_aid")))
    return covered.select(F.col("id").alias(id_col), F.col("key").alias(key),
                          after.alias("suppressed"))


def latest_per_key(entries: DataFrame, key: str, ts: str, id_col: str) -> DataFrame:
    """Upsert: the newest entry of every key (combined map-side)."""
    rest = [c for c in entries.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(id_col)))
    return entries.groupBy(key).agg(newest.alias("_e")).select(key, "_e.*")

"""Replaying searches: result cache and pause after a failure, as one state machine.

An attempt first looks for its key in the cache; a stored answer within its lifetime is a hit.
Otherwise it is suppressed while its service pauses, that is for some time after it was found
offline.  Otherwise it is made: an answer is stored, being offline starts a pause, and other outcomes
change nothing.

The state of one key is what its last answer or failure left behind, so its outcome alone says which
later answer or failure of the key is the next that can happen.  These steps are composed by doubling,
for all keys at once; attempts that change nothing are made where nothing rules them.

Pauses that hold for a service can't be composed with the answers of keys that several services ask
for.  Rounds take the pauses of the round before as given, find the stored answers and then the
pauses, and end when these stay the same, which only the true ones do, as each event depends on
earlier ones alone.  Rounds are as many as pauses and answers decide on each other in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom import constants as K
from themeloom.operators import replay
from themeloom.session import materialize

HIT, SUPPRESSED, MADE = "hit", "suppressed", "made"


def _covered(events: DataFrame, group: str, chain: DataFrame, gap: int, strict: bool) -> DataFrame:
    """``events`` with _a and _aid, the anchor of the chain (key, t, id) that rules each, or null."""
    columns = events.columns
    renamed = events.withColumnsRenamed({"key": "_key", group: "key"}) if group != "key" else events
    ruled = replay.covered_events(renamed, chain, gap, strict)
    if group != "key":
        ruled = ruled.withColumnsRenamed({"key": group, "_key": "key"})
    after = (F.col("t") > F.col("_a")) | (F.col("id") > F.col("_aid"))
    return ruled.select(*columns, F.when(after, F.col("_a")).alias("_a"),
                        F.when(after, F.col("_aid")).alias("_aid"))


def _digest(chain: DataFrame) -> tuple:
    mark = F.xxhash64("key", "t", "id").cast("decimal(38,0)")
    return tuple(chain.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _settled(turning: DataFrame, ok: Column, offline: Column, ttl: int, pause: int
             ) -> tuple[DataFrame, DataFrame]:
    """Stored answers (of a key) and pauses (of a service as key) that agree with each other."""
    answers, failures = turning.filter(ok), turning.filter(offline)
    pauses, seen = None, None
    while True:
        free = answers if pauses is None else materialize(_covered(
            answers, "service", pauses, pause, False).filter("_a is null"))
        stored = materialize(replay.chain(free.select("key", "t", "id", "reach"), ttl))
        met = _covered(failures, "key", stored, ttl, True).filter("_a is null")
        pauses = materialize(replay.chain(
            met.select(F.col("service").alias("key"), "t", "id", "reach"), pause))
        now = _digest(pauses)
        if now == seen:
            return stored, pauses
        seen = now


def replay_searches(attempts: DataFrame, key: str, ts: str, id_col: str, outcome: str,
                    service: str | None = None, ttl_hours: float = K.CACHE_TTL_HOURS,
                    cooldown_seconds: float = K.OFFLINE_COOLDOWN_SECONDS) -> DataFrame:
    """(id, key, state, status, source_id, cached_us) of every attempt of a log.

    ``outcome`` is what an attempt meets if it is made: "ok", "offline" or anything else; null is an
    error.  ``state`` says what became of it, ``status`` what the asker sees: "ok" for a hit,
    "offline" for a suppressed attempt, else the outcome.  ``source_id`` is the attempt whose answer
    is shown, ``cached_us`` its time: the earlier one of a hit, the own one of an answer.  Attempts
    of one time are in the order of their ids, which are unique.  Pauses hold for a service, by
    default for a key.
    """
    ttl, pause = int(ttl_hours * 3_600_000_000), int(cooldown_seconds * 1_000_000)
    events = materialize(attempts.select(
        F.col(key).alias("key"), F.col(service or key).alias("service"),
        replay.micros(attempts, ts).alias("t"), F.col(id_col).alias("id"),
        F.coalesce(F.col(outcome), F.lit(K.STATUS_ERROR)).alias("outcome")))
    ok, offline = F.col("outcome") == K.STATUS_OK, F.col("outcome") == K.STATUS_OFFLINE
    # Without a lifetime or a pause, events of the same time are still ruled.
    turning = events.filter(ok | offline).withColumn("reach", F.when(ok, ttl + 1).otherwise(
        max(pause, 1)))
    if service is None:
        steps = replay.chain(turning.select("key", "t", "id", "reach"), min(pause, ttl))
        made = materialize(turning.join(steps, ["key", "t", "id"], "left_semi"))
        stored, pauses = made.filter(ok), made.filter(offline)
    else:
        stored, pauses = _settled(turning, ok, offline, ttl, pause)
    stored, pauses = stored.select("key", "t", "id"), pauses.select("key", "t", "id")
    hits = _covered(events, "key", stored, ttl, True).withColumnsRenamed(
        {"_a": "_stored", "_aid": "_source"})
    ruled = _covered(hits, "service", pauses, pause, False)
    state = (F.when(F.col("_stored").isNotNull(), HIT)
             .when(F.col("_a").isNotNull(), SUPPRESSED).otherwise(MADE))
    own = (state == MADE) & ok
    return ruled.select(
        F.col("id").alias(id_col), F.col("key").alias(key), state.alias("state"),
        F.when(state == HIT, K.STATUS_OK).when(state == SUPPRESSED, K.STATUS_OFFLINE).otherwise(
            F.col("outcome")).alias("status"),
        F.when(state == HIT, F.col("_source")).when(own, F.col("id")).alias("source_id"),
        F.when(state == HIT, F.col("_stored")).when(own, F.col("t")).alias("cached_us"))

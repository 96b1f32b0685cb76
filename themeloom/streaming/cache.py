"""Result cache as a stream: hit or miss for each lookup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from themeloom import constants as K


def stream_cache(log: DataFrame, key: str, ts: str, id_col: str,
                 ttl_hours: float = K.CACHE_TTL_HOURS, delay: str | None = None) -> DataFrame:
    """(id, key, hit, cached_at): state per key is one time stamp.

    Every lookup gets a row.  Lookups are ordered inside a micro-batch; across batches they count as
    they come.  With ``delay`` a stamp is let go once the watermark has passed its lifetime, so
    state holds live entries only, and Spark leaves out lookups that are later than that.
    """
    ttl = int(ttl_hours * 3_600_000_000)
    rows = (log.withWatermark(ts, delay) if delay else log).select(
        F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("t"),
        F.col(id_col).alias("id"))

    def lookup(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        stamp = state.get[0] if state.exists else None
        out = []
        batch = pd.concat(list(frames)).sort_values(["t", "id"])
        for row in batch.itertuples(index=False):
            hit = stamp is not None and row.t - stamp <= ttl
            if not hit:
                stamp = int(row.t)
            out.append((row.id, group[0], hit, stamp))
        state.update((stamp,))
        if delay:
            expires = (stamp + ttl) // 1_000 + 1
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "key", "hit", "stamp"])

    kind = dict(log.dtypes)
    result = rows.groupBy("key").applyInPandasWithState(
        lookup, f"id {kind[id_col]}, key {kind[key]}, hit boolean, stamp long", "stamp long",
        "append", GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout)
    return result.select(F.col("id").alias(id_col), F.col("key").alias(key), "hit",
                         F.timestamp_micros("stamp").alias("cached_at"))

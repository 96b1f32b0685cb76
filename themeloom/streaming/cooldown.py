"""Attempts under the pause after a failure, as a stream in event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from themeloom import constants as K


class Cooldown(StatefulProcessor):
    """Attempts of a key wait until the watermark has passed them, then go in the order of time.

    State is the end of the last pause and the waiting attempts, which the watermark's delay bounds.
    """

    def __init__(self, pause_us: int, id_type: str):
        self.pause, self.id_type = pause_us, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")
        self.waiting = handle.getListState("waiting", f"t long, id {self.id_type}, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        latest = 0
        for frame in rows:
            values = list(frame[["t", "id", "failed"]].itertuples(index=False, name=None))
            self.waiting.appendList([(int(t), i, bool(f)) for t, i, f in values])
            latest = max(latest, int(frame["t"].max()))
        # The first watermark beyond all of these rows.
        self.handle.registerTimer(latest // 1_000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < passed]
        if not ready:
            return
        self.waiting.clear()
        if len(ready) < len(rows):
            self.waiting.put(rows[len(ready):])
        until = self.until.get()[0] if self.until.exists() else None
        t = np.array([r[0] for r in ready], dtype=np.int64)
        suppressed = np.zeros(len(t), dtype=bool)
        failures = np.flatnonzero([r[2] for r in ready])
        at = 0
        if until is not None:
            at = int(np.searchsorted(t, until))
            suppressed[:at] = True
        # From one failure that counts to the next: the first at or after the end of its pause.
        while len(later := failures[failures >= at]):
            first = int(later[0])
            until = int(t[first]) + self.pause
            at = max(int(np.searchsorted(t, until)), first + 1)
            suppressed[first + 1:at] = True
        if until is not None:
            self.until.update((until,))
        yield pd.DataFrame({"id": [r[1] for r in ready], "key": key[0], "suppressed": suppressed})

    def close(self) -> None:
        pass


def stream_cooldown(attempts: DataFrame, key: str, ts: str, id_col: str, failed: str,
                    cooldown_seconds: float = K.OFFLINE_COOLDOWN_SECONDS,
                    delay: str = "10 minutes") -> DataFrame:
    """(id, key, suppressed): streaming twin of ``apply_cooldown``, row by row.

    Attempts may arrive up to ``delay`` out of order; each comes out once the watermark has passed
    it.  Spark leaves out what is later than that.  ``failed`` names a boolean column; ids are told
    apart and sorted inside one time.  Needs a state store that supports timers (RocksDB).
    """
    kinds = dict(attempts.dtypes)
    rows = attempts.withWatermark(ts, delay).select(
        F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("t"),
        F.col(id_col).alias("id"), F.col(failed).alias("failed"))
    done = rows.groupBy("key").transformWithStateInPandas(
        Cooldown(int(cooldown_seconds * 1_000_000), kinds[id_col]),
        f"id {kinds[id_col]}, key {kinds[key]}, suppressed boolean", "append", "EventTime")
    return done.withColumnsRenamed({"id": id_col, "key": key})

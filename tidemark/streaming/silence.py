"""Assets of a live series that fall silent and come back, told from state and timers.

A window over a stream says nothing of an asset that sends no rows.  Here each
asset has its last time as state and a timer; when the watermark passes the
timer without a newer row, the asset is silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``silent``: no row from since on, noticed at ``until`` (since + limit); ``back``: the first row after that, at ``until``.
CHANGES = "asset_id string, change string, since timestamp, until timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Silence(StatefulProcessor):
    """State: the last time of an asset in milliseconds, and whether it is told to be silent."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat([r["timestamp"] for r in rows])
        first, last = (int(t.value // 1_000_000) for t in (seen.min(), seen.max()))
        before, silent = self.state.get() if self.state.exists() else (last, False)
        if silent and first > before:
            yield self.change(key, "back", before, first)
            silent = False
        if last >= before and not silent:
            self._wait(before, last)
            self.state.update((last, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.state.get()
        self.state.update((last, True))
        yield self.change(key, "silent", last, last + self.limit)

    def _wait(self, before: int, last: int) -> None:
        self.handle.deleteTimer(before + self.limit)
        self.handle.registerTimer(last + self.limit)

    def change(self, key, change: str, since: int, until: int) -> pd.DataFrame:
        return pd.DataFrame({"asset_id": [key[0]], "change": [change], "since": [pd.Timestamp(since, unit="ms")], "until": [pd.Timestamp(until, unit="ms")]})

    def close(self) -> None:
        pass


def changes(series: DataFrame, limit_minutes: float = 60, lateness: str = "10 minutes") -> DataFrame:
    """CHANGES of a streaming series (asset_id, timestamp); rows later than the watermark are left out, as are those of no asset.

    Needs a state store with timers, which is set for the session.
    """
    series.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = series.where("asset_id IS NOT NULL").select("asset_id", F.col("timestamp").cast("timestamp").alias("timestamp")).withWatermark("timestamp", lateness)
    return rows.groupBy("asset_id").transformWithStateInPandas(Silence(int(limit_minutes * 60_000)), CHANGES, "append", "eventTime")

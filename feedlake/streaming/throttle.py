"""Rolling per-key admission over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from feedlake.functions.timestamps import micros
from feedlake.operators.throttle import admit
from feedlake.session import ship

ship(__name__)

ADMIT = StructType([StructField("at", LongType())])


class ThrottleProcessor(StatefulProcessor):
    """State of a key: its admits that are younger than the window, at most ``limit``.

    A timer at the end of the last admit's window clears keys that have gone quiet.
    """

    def __init__(self, limit: int, window: int):
        self._limit, self._window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._recent = handle.getListState("recent", ADMIT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [int(r[0]) for r in self._recent.get()] if self._recent.exists() else []
        batch = pd.concat(list(rows)).sort_values(["at", "tie"])
        answers, recent = admit(batch["at"].to_numpy(dtype=np.int64), recent, self._limit, self._window)
        self._recent.put([(int(t),) for t in recent])
        self._handle.registerTimer((recent[-1] + self._window) // 1000 + 1)
        out = pd.DataFrame({"tie": batch["tie"].to_numpy(), "key": [key[0]] * len(batch), "admitted": answers})
        # Text as plain objects: chunked Arrow strings are not accepted here.
        yield out.astype({c: object for c in ("tie", "key") if not pd.api.types.is_numeric_dtype(out[c])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        alive = [int(r[0]) for r in self._recent.get() if now - int(r[0]) < self._window] if self._recent.exists() else []
        if alive:
            self._recent.put([(t,) for t in alive])
        else:
            self._recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(
    requests: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id", limit: int = 60, window_s: int = 60
) -> DataFrame:
    """``tie``, ``key``, ``admitted``; the watermark is one window, later rows are dropped.

    Needs the RocksDB state store provider. A key's rows of one micro-batch are handled
    together, so bound the micro-batch at the source.
    """
    stamped = requests.withWatermark(ts, f"{window_s} seconds").select(
        F.col(key).alias("key"), F.col(ts), micros(ts).alias("at"), F.col(tie).alias("tie")
    )
    schema = stamped.schema
    out = StructType([StructField("tie", schema["tie"].dataType), StructField("key", schema["key"].dataType)]).add("admitted", "boolean")
    answered = stamped.groupBy("key").transformWithStateInPandas(
        ThrottleProcessor(limit, window_s * 1_000_000), out, "append", "EventTime"
    )
    return answered.withColumnRenamed("tie", tie)

"""The sliding-log limiter over a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType


class SlidingLog(StatefulProcessor):
    """Accepted timestamps per key; events of a batch are taken in time order."""

    def __init__(self, most: int, window: float):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", StructType([StructField("ts", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = sorted(t for (t,) in self.log.get())
        out = []
        for now in sorted(t for part in rows for t in part["ts"]):
            log = [t for t in log if now - t < self.window]
            if len(log) >= self.most:
                out.append((key[0], now, False, max(1, math.ceil(self.window - (now - log[0])))))
            else:
                log.append(now)
                out.append((key[0], now, True, None))
        self.log.put([(t,) for t in log])
        yield pd.DataFrame(out, columns=["key", "ts", "accepted", "retry_after"]).astype({"retry_after": "Int32"})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, most: int, window: float, key_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """``(key, ts, accepted, retry_after)`` of a stream.  Events later than a batch after their own aren't put back in order."""
    rows = events.select(F.col(key_col).alias("key"), F.col(ts_col).cast("double").alias("ts"))
    schema = StructType([rows.schema["key"], *StructType.fromDDL("ts double, accepted boolean, retry_after int").fields])
    return rows.groupBy("key").transformWithStateInPandas(SlidingLog(most, window), schema, "append", "None")

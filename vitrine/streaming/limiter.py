"""Rate limiting with a state and a timer per client.

Fixed windows of one client are kept as two short arrays and closed by a timer
once the watermark has passed their end, so the state holds open windows only.
A request whose window is closed is late: it is counted too, but apart.

Spark drops rows behind the watermark before they reach a stateful operator
that can see the event-time column. The operator therefore sees the moment as a
number, and judges lateness itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "starts array<bigint>, counts array<bigint>"


class FixedWindows(StatefulProcessor):
    """Rows: ``client, at`` (microseconds). Out: the touched windows' running counts, the
    number of late requests per closed window, and windows as they close."""

    def __init__(self, client: str, width: int) -> None:
        self.client, self.width = client, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _load(self) -> dict[int, int]:
        held = self.open.get()
        return dict(zip(held[0], held[1], strict=True)) if held is not None else {}

    def _store(self, windows: dict[int, int]) -> None:
        """Keep the open windows, with one timer for the one that ends first."""
        if windows:
            self.open.update((list(windows), list(windows.values())))
            self.handle.registerTimer(-(-(min(windows) + self.width) // 1000))
        else:
            self.open.clear()

    def _out(self, key: tuple, rows: list[tuple[int, int, int, bool]]) -> pd.DataFrame:
        starts, accepted, late, closed = zip(*rows, strict=True)
        columns = {self.client: [key[0]] * len(rows), "start": starts, "requests": accepted, "late": late, "closed": closed}
        return pd.DataFrame(columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        arrived: dict[int, int] = {}
        for part in rows:
            starts, counts = np.unique(part["at"].to_numpy() // self.width * self.width, return_counts=True)
            for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
                arrived[start] = arrived.get(start, 0) + count
        late = {start: n for start, n in arrived.items() if start + self.width <= mark}
        out = [(start, 0, n, True) for start, n in late.items()]
        if len(late) < len(arrived):
            windows = self._load()
            for start in arrived.keys() - late.keys():
                windows[start] = windows.get(start, 0) + arrived[start]
                out.append((start, windows[start], 0, False))
            self._store(windows)
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        windows = self._load()
        done = [start for start in windows if start + self.width <= mark]
        out = [(start, windows.pop(start), 0, True) for start in done]
        self._store(windows)
        if out:
            yield self._out(key, out)

    def close(self) -> None:
        pass


def windows(requests: DataFrame, client: str, moment: str, width_micros: int, watermark: str | None) -> DataFrame:
    """Running counts per client and window: ``client, window_start, requests, late, closed``.
    ``requests`` grows with every trigger; ``late`` is what came in this trigger after the close.
    Without a ``watermark`` no window closes. Rows without a client or a moment are no requests."""
    zoned = requests.withColumn(moment, F.col(moment).cast("timestamp"))
    marked = zoned if watermark is None else zoned.withWatermark(moment, watermark)
    rows = marked.select(client, F.unix_micros(moment).alias("at")).filter(F.col("at").isNotNull() & F.col(client).isNotNull())
    schema = T.StructType([rows.schema[client], *T._parse_datatype_string("start bigint, requests bigint, late bigint, closed boolean")])
    mode = "None" if watermark is None else "EventTime"
    processor = (FixedWindows if mode == "EventTime" else _Unclosed)(client, width_micros)
    counted = rows.groupBy(client).transformWithStateInPandas(processor, schema, "Update", mode)
    return counted.select(client, F.timestamp_micros("start").alias("window_start"), "requests", "late", "closed")


class _Unclosed(FixedWindows):
    """Without a watermark there is nothing to wait for, and no timer."""

    def _store(self, windows: dict[int, int]) -> None:
        self.open.update((list(windows), list(windows.values())))


def totals(log: DataFrame, client: str, limit: int) -> DataFrame:
    """All requests per client and window out of a log of ``windows``: those accepted while
    the window was open, those that came late, both, and whether both exceed the limit."""
    every = F.col("accepted") + F.col("late")
    summed = log.groupBy(client, "window_start").agg(F.max("requests").alias("accepted"), F.sum("late").alias("late"))
    return summed.withColumns({"requests": every, "limited": every > limit})

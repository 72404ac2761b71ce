"""Sliding-window admission for each key.

A hit is admitted if fewer than ``limit`` admitted hits of its key lie within the last
``window`` seconds; a hit exactly ``window`` seconds old is out. Rejected hits leave no
trace, so this is no window aggregate but a fold over each key's hits in order. Hits
without a key share one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, event_id long, at double, allowed boolean"


def admit(hits: deque[float], at: float, limit: int, window: float) -> bool:
    """Takes or refuses a hit; ``hits`` are the admitted ones, oldest first."""
    while hits and hits[0] <= at - window:
        hits.popleft()
    if len(hits) >= limit:
        return False
    hits.append(at)
    return True


class Limiter(StatefulProcessor):
    """Admitted hits of a key, between batches in a list state of at most ``limit`` entries."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("hits", "at double")

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits = deque(r[0] for r in self.held.get())
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        batch["allowed"] = [admit(hits, at, self.limit, self.window) for at in batch["at"]]
        self.held.put([(x,) for x in hits]) if hits else self.held.clear()
        yield batch.assign(key=key[0])[["key", "event_id", "at", "allowed"]]

    def close(self) -> None:
        pass


def _prepared(events: DataFrame, key: str, time: str, event_id: str) -> DataFrame:
    return events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("_us")).select("key", "event_id", (F.col("_us") / 1e6).alias("at"))


def limit_stream(events: DataFrame, limit: int = 20, window: float = 60.0, key: str = "key", time: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Admission over a stream, by its ``time`` column (set it to the arrival time for a live limiter).

    Needs the RocksDB state store, as all processors of this kind.
    """
    grouped = _prepared(events, key, time, event_id).groupBy("key")
    return grouped.transformWithStateInPandas(Limiter(limit, window), OUT, "Append", "None")


def limit_batch(events: DataFrame, limit: int = 20, window: float = 60.0, key: str = "key", time: str = "ts", event_id: str = "event_id") -> DataFrame:
    """The same over a table.

    Hits are sorted by key and time and folded as they stream by, so a busy key takes time
    but no memory beyond its admitted hits.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hits = None, deque()
        for frame in frames:
            said = []
            for k, at in zip(frame["key"], frame["at"], strict=True):
                if k != own:
                    own, hits = k, deque()
                said.append(admit(hits, at, limit, window))
            yield frame.assign(allowed=said)

    ordered = _prepared(events, key, time, event_id).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(run, OUT)

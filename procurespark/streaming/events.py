"""At-least-once events: repeated and stale ones are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def once_only(events: DataFrame, key: str = "idempotency_key", time: str = "occurred_at", lateness: str = "1 hour") -> DataFrame:
    """A stream's events once for each key, remembered for ``lateness`` after the newest event."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, entity: str = "entity_id", time: str = "occurred_at", key: str = "idempotency_key") -> DataFrame:
    """The newest event of each entity in a table; repeats of a key and older events drop out.

    Both steps combine before their shuffle, so a busy entity is no burden.
    """
    row = F.struct(*(F.col(c) for c in events.columns))
    once = events.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(time)).alias("_row")).select("_row.*")
    newest = once.groupBy(F.col(entity).alias("_entity")).agg(F.max_by(row, F.struct(F.col(time), F.col(key))).alias("_row"))
    return newest.select("_row.*")


#: Where an event takes an order; any other pair leaves it as it is.
ORDER_START = "open"
ORDER_STEPS = {
    ("open", "confirmed"): "confirmed",
    ("open", "submitted"): "pending_approval",
    ("pending_approval", "confirmed"): "confirmed",
    ("pending_approval", "cancelled"): "cancelled",
    ("confirmed", "paid"): "paid",
    ("confirmed", "cancelled"): "cancelled",
}
EXCEPTION_START = "raised"
EXCEPTION_STEPS = {("raised", "resolved"): "resolved"}


def folded_state(events: DataFrame, start: str, steps: dict[tuple[str, str], str], entity: str = "entity_id", event: str = "event", time: str = "occurred_at", key: str = "idempotency_key") -> DataFrame:
    """``entity, state, refused``: each entity's state after its events in order of time, each key once, and how many events led nowhere.

    An entity has as many events as its life has steps, so they are folded in its row.
    """
    once = events.groupBy(key).agg(F.min_by(F.struct(F.col(entity).alias("entity"), F.col(event).alias("event"), F.col(time).alias("at")), time).alias("_e")).select("_e.*", F.col(key).alias("key"))
    ordered = once.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "key", "event"))).alias("events"))
    table = F.create_map(*(F.lit(x) for (old, by), new in steps.items() for x in (f"{old}|{by}", new)))

    def step(state: Column, e: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("|", state["state"], e["event"]))
        return F.struct(F.coalesce(to, state["state"]).alias("state"), (state["refused"] + to.isNull().cast("int")).alias("refused"))

    end = F.aggregate("events", F.struct(F.lit(start).alias("state"), F.lit(0).alias("refused")), step)
    return ordered.select("entity", end.alias("_s")).select("entity", "_s.state", "_s.refused")


class _Machine(StatefulProcessor):
    """One entity's state, its events that wait for their time, and the keys that it has seen."""

    def __init__(self, start: str, steps: dict[tuple[str, str], str], remembered: int):
        self.start, self.steps, self.remembered = start, steps, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, read and written once a call, as each access of a state costs about a millisecond.
        self.held = handle.getValueState("held", "state string, refused int, repeated int, applied int, due long, at array<long>, keys array<string>, events array<string>, seen array<string>, seen_at array<long>")

    def _now(self) -> tuple[list, list[tuple], dict[str, int]]:
        held = self.held.get() or (self.start, 0, 0, 0, None, [], [], [], [], [])
        return list(held[:5]), list(zip(*held[5:8], strict=True)), dict(zip(*held[8:], strict=True))

    def _kept(self, entity: str, counts: list, waiting: list[tuple], seen: dict[str, int]) -> pd.DataFrame:
        """What is kept of an entity, and its row; one timer is enough, that of the earliest event that waits."""
        earliest = min((at for at, *_ in waiting), default=None)
        if earliest is not None and (counts[4] is None or earliest < counts[4]):
            self.handle.registerTimer(earliest)
            counts[4] = earliest
        at, keys, events = ([e[k] for e in waiting] for k in range(3))
        self.held.update((*counts, at, keys, events, list(seen), list(seen.values())))
        return pd.DataFrame({"entity": [entity]} | {c: [v] for c, v in zip(("state", "refused", "repeated", "applied"), counts, strict=False)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts, waiting, seen = self._now()
        for frame in rows:
            for event, at, name in zip(frame["event"], frame["at"], frame["key"], strict=True):
                if name in seen:
                    counts[2] += 1
                else:
                    seen[name] = int(at)
                    waiting.append((int(at), name, event))
        yield self._kept(key[0], counts, waiting, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All events whose time has passed, in one go: the state is read and written once, however many there are."""
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        (state, refused, repeated, applied, _), waiting, seen = self._now()
        ready = sorted((e for e in waiting if e[0] <= until), key=lambda e: e[:2])
        for _, _, event in ready:
            to = self.steps.get((state, event))
            refused += to is None
            state = state if to is None else to
        later = [e for e in waiting if e[0] > until]
        remembered = {name: at for name, at in seen.items() if at > until - self.remembered}
        yield self._kept(key[0], [state, refused, repeated, applied + len(ready), None], later, remembered)

    def close(self) -> None:
        pass


def streamed_state(events: DataFrame, start: str, steps: dict[tuple[str, str], str], entity: str = "entity_id", event: str = "event", time: str = "occurred_at", key: str = "idempotency_key", lateness: str = "1 hour", remembered_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``entity, state, refused, repeated, applied`` of a stream's entities whenever they change; a restarted query goes on with its states.

    Events wait until the watermark, ``lateness`` behind the newest event, has passed them, and are then applied in order
    of time (in milliseconds) and key, so they may come in any order within that. A key that was seen counts as repeated, for
    ``remembered_ms`` after its event; an event that comes behind the watermark is not applied, and ``run_once`` counts it. Once all have
    been applied the states are those of ``folded_state``. An entity keeps its waiting events and its remembered keys.
    """
    held = events.withWatermark(time, lateness).select(F.col(entity).cast("string").alias("entity"), F.col(event).alias("event"), F.col(time), F.unix_millis(F.col(time)).alias("at"), F.col(key).cast("string").alias("key"))
    out = "entity string, state string, refused int, repeated int, applied int"
    return held.groupBy("entity").transformWithStateInPandas(_Machine(start, steps, remembered_ms), out, "Update", "EventTime")


def latest_rows(written: DataFrame) -> DataFrame:
    """The last row of each entity of a table that states were appended to: counters never fall, so it is the latest, of those written at once that with the most behind it."""
    order = F.struct("written", F.col("applied") + F.col("repeated"))
    return written.groupBy("entity").agg(F.max_by(F.struct("state", "refused", "repeated"), order).alias("_row")).select("entity", "_row.*")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """What has arrived since the last run, appended to ``path``; a weekly job of the same call goes on from there. Returns how many rows were too late.

    With ``mode`` update, rows that changed are appended batch by batch; a batch that is done again after a failure overwrites its own folder.
    """
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}")).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators)

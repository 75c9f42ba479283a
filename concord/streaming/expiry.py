"""Clusters of a stream that are forgotten when nothing has come for a time: by the time of the records, or by the clock.

Both need a session made by `intake.stream_session`; the caller's session keeps its settings.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "start bigint, stop bigint, members bigint, low double, high double"
#: A life of a cluster: from its first record to the last one before it was idle; times in milliseconds.
LIFE = f"cluster string, {STATE}, expired boolean"
_PIECE = f"cluster string, {STATE}, last timestamp"


def _lives(pieces: list[tuple], idle: int) -> list[tuple]:
    """Pieces `start, stop, members, low, high` put together where no more than `idle` lies between them, in order."""
    found: list[tuple] = []
    for start, stop, members, low, high in sorted(pieces):
        if found and start - found[-1][1] <= idle:
            a, b, n, x, y = found[-1]
            found[-1] = (a, max(b, stop), n + members, min(x, low), max(y, high))
        else:
            found.append((start, stop, members, low, high))
    return found


def _combined(idle: int):
    """Rows of a task put together per cluster, so that a hot cluster sends a few rows to its state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.sort_values(["cluster", "at"], kind="stable")
            gap = (rows["cluster"] != rows["cluster"].shift()) | (rows["at"] - rows["at"].shift() > idle)
            grouped = rows.groupby([rows["cluster"], gap.cumsum().rename("life")], sort=False)
            found = grouped.agg(start=("at", "min"), stop=("at", "max"), members=("at", "size"), low=("num", "min"), high=("num", "max"))
            found = found.reset_index().drop(columns="life")
            found["last"] = pd.to_datetime(found["stop"], unit="ms", utc=True)
            yield found

    return run


class ExpiringClusters(StatefulProcessor):
    """The current life of a cluster; a timer ends it `idle` milliseconds of event time after its last record."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = [tuple(self.state.get())] if self.state.exists() else []
        for piece in rows:
            found = piece[["start", "stop", "members", "low", "high"]].itertuples(index=False, name=None)
            pieces += [(int(a), int(b), int(n), float(x), float(y)) for a, b, n, x, y in found]
        lives = _lives(pieces, self.idle)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(lives[-1][1] + self.idle)
        self.state.update(lives[-1])
        yield self._out(key, lives, [True] * (len(lives) - 1) + [False])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        life = tuple(self.state.get())
        self.state.clear()
        yield self._out(key, [life], [True])

    @staticmethod
    def _out(key, lives: list[tuple], expired: list[bool]) -> pd.DataFrame:
        found = pd.DataFrame(lives, columns=["start", "stop", "members", "low", "high"])
        found.insert(0, "cluster", key[0])
        return found.assign(expired=expired)

    def close(self) -> None:
        pass


def stream_expiring_clusters(records: DataFrame, idle_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Lives (`LIFE`) of the clusters of a stream `cluster, at timestamp, num`: all that a batch changed. A cluster whose last record
    lies `idle_ms` before the watermark is forgotten; what comes later under its key is a new life.

    Rows without `at` are left out, rows later than the watermark (`delay` behind the newest, and not before 1970) are dropped.
    """
    rows = records.filter("at IS NOT NULL").select("cluster", F.unix_millis("at").alias("at"), F.col("num").cast("double").alias("num"))
    pieces = rows.mapInPandas(_combined(idle_ms), _PIECE).withWatermark("last", delay)
    return pieces.groupBy("cluster").transformWithStateInPandas(ExpiringClusters(idle_ms), LIFE, "Update", "EventTime")


class TimedClusters(StatefulProcessor):
    """Members and ends of a cluster, which the state store forgets `ttl` milliseconds after they were written last."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cluster", "members bigint, low double, high double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        members, low, high = self.state.get() if self.state.exists() else (0, float("inf"), float("-inf"))
        for piece in rows:
            members += int(piece["members"].sum())
            low, high = min(low, float(piece["low"].min())), max(high, float(piece["high"].max()))
        self.state.update((members, low, high))
        yield pd.DataFrame({"cluster": [key[0]], "members": [members], "low": [low], "high": [high]})

    def close(self) -> None:
        pass

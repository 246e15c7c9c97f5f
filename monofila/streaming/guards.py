"""Streaming rate limit and lockout: the batch folds with keyed state.

Attempts are judged in the order they arrive. A task takes a key's share of a micro-batch in
pieces of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, each put in order of time, then id,
so a key's backlog is never held as a whole, however hot the key is; up to that many rows of a key
in a micro-batch the order is exactly time, then id. A watermark on the attempts' own time would
drop late ones unseen, so it is set on their arrival: every attempt is judged, however late. The
state is a few integers per key in RocksDB. A key that sends nothing for as long as its state
matters, and ``idle_seconds`` more, loses it by a timer, so idle keys cost nothing; ``slack`` is how
far the driver's clock may step back between batches. (Timers in processing time would keep an
``availableNow`` query from ever ending.) Attempts without a key form one key of their own; one
without a time or id fails the query.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from monofila.operators.chunks import Fold, State, plain, required
from monofila.operators.events import _MICROS, accept, lock_out

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accept_late(times: np.ndarray, marks: np.ndarray, state: State, limit: int, window: int) -> tuple[np.ndarray, State]:
    """``accept`` for rows that may be older than rows judged before them.

    The state is the ``limit`` latest accepted times: if all of them are younger than the window
    the row is refused, else every accepted time that counts is among them. Late rows are walked
    one by one, the others folded.
    """
    recent, late = list(state), 0
    taken = np.zeros(len(times), dtype=np.int32)
    while late < len(times) and recent and times[late] < recent[-1]:
        if len(recent) < limit or times[late] - recent[-limit] >= window:
            insort(recent, int(times[late]))
            recent, taken[late] = recent[-limit:], 1
        late += 1
    if late < len(times):
        taken[late:], _ = accept(times[late:], marks[late:], recent, limit, window)
        recent = [*recent, *times[late:][taken[late:] == 1][-limit:].tolist()][-limit:]
    return taken, recent


class Judge(StatefulProcessor):
    """Folds a key's rows piece by piece. ``expires`` gives the moment a state stops mattering,
    from it and the last event."""

    def __init__(self, fold: Fold, expires: Callable[[State, int], int], idle_seconds: int) -> None:
        self.fold, self.expires, self.idle = fold, expires, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "state array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.carried.get()
        state, last = list(held[0]) if held else [], None
        arrived = 0
        for piece in rows:
            piece = piece.sort_values(["at", "row_id"])
            outcomes, state = self.fold(piece["at"].to_numpy(), piece["mark"].to_numpy(dtype=bool), state)
            newest = int(piece["at"].iloc[-1])
            last = newest if last is None else max(last, newest)
            arrived = max(arrived, int(piece["arrived"].max()))
            yield pd.DataFrame({"keyless": key[0], "key": key[1], "row_id": piece["row_id"].to_numpy(), "outcome": outcomes})
        if last is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state:
            self.carried.update((state,))
            span = max(0, self.expires(state, last) - last) // 1000 + self.idle
            self.handle.registerTimer(max(arrived + span, timerValues.getCurrentWatermarkInMs()) + 1)
        else:
            self.carried.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.carried.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB state store; it is chosen for the session where
    none has been. A session with another one is left as it is, and Spark refuses the query."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _judge(
    rows: DataFrame, mark: Column, key: str, time: str, row_id: str, idle_seconds: int, slack: str, fold: Fold,
    expires: Callable[[State, int], int], outcome: str,
) -> DataFrame:
    keyed_state(rows.sparkSession)
    some_key = plain(rows, key)
    slim = rows.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", slack).select(
        "_arrival", F.unix_millis("_arrival").alias("arrived"), some_key.isNull().alias("keyless"),
        F.coalesce(some_key, F.lit("0").cast(rows.select(some_key).schema[0].dataType)).alias("key"),
        required(F.unix_micros(F.col(time).cast("timestamp")), "time").alias("at"),
        required(plain(rows, row_id), "id").alias("row_id"), F.coalesce(mark, F.lit(False)).alias("mark"),
    )
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    judged = slim.groupBy("keyless", "key").transformWithStateInPandas(
        Judge(fold, expires, idle_seconds),
        f"keyless boolean, key {types['key']}, row_id {types['row_id']}, outcome {outcome}", "Append", "EventTime",
    )
    return judged.select(F.col("row_id").alias(row_id), F.when(~F.col("keyless"), F.col("key")).alias(key), "outcome")


def rate_limit_stream(
    events: DataFrame, key: str = "user_id", time: str = "ts", row_id: str = "event_id",
    limit: int = 3, window_seconds: int = 900, idle_seconds: int = 3_600, slack: str = "1 minute",
) -> DataFrame:
    window = window_seconds * _MICROS
    fold = partial(accept_late, limit=limit, window=window)
    judged = _judge(events, F.lit(False), key, time, row_id, idle_seconds, slack, fold, lambda _, last: last + window, "int")
    return judged.withColumnRenamed("outcome", "accepted")


def lockout_stream(
    attempts: DataFrame, failed: Column, key: str = "user_id", time: str = "ts", row_id: str = "event_id",
    failures: int = 5, lock_seconds: int = 900, keep_seconds: int | None = None, idle_seconds: int = 3_600, slack: str = "1 minute",
) -> DataFrame:
    """``keep_seconds`` bounds how long an unfinished failure streak is remembered;
    without it, a streak lives until a success."""
    century = 100 * 365 * 86_400
    keep = (century if keep_seconds is None else keep_seconds) * _MICROS

    def expires(state: State, last: int) -> int:
        streak, locked_until = state
        return max(locked_until, last + keep if streak else 0)

    fold = partial(lock_out, failures=failures, duration=lock_seconds * _MICROS)
    return _judge(attempts, failed, key, time, row_id, idle_seconds, slack, fold, expires, "string")

"""Rules over an event table: rate limit, lockout, failure streaks, retention."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monofila.operators.chunks import Course, State, fold_rows, ordered_chunks

_MICROS = 1_000_000


def accept(times: np.ndarray, marks: np.ndarray, state: State, limit: int, window: int) -> tuple[np.ndarray, State]:
    """Rate limit: accept while fewer than ``limit`` accepted events are younger than
    ``window``. The state holds the accepted times that still count; refused events
    leave none.

    An event at least ``window`` after the one ``limit`` places before it is accepted
    whatever happened earlier. Only the others are walked, and a refused stretch is
    jumped with one binary search.
    """
    size, recent, done = len(times), list(state), 0
    taken = np.ones(size, dtype=np.int32)
    crowded = np.flatnonzero(times[limit:] - times[:-limit] < window) + limit
    doubtful = np.concatenate([np.arange(min(limit, size)), crowded])
    d = 0
    while d < len(doubtful):
        i = int(doubtful[d])
        if i > done:
            recent = [*recent, *times[max(done, i - limit):i].tolist()][-limit:]
        if len(recent) >= limit and times[i] - recent[-limit] < window:
            done = int(np.searchsorted(times, recent[-limit] + window, side="left"))
            taken[i:done] = 0
            d = int(np.searchsorted(doubtful, done))
        else:
            recent, done, d = [*recent, int(times[i])][-limit:], i + 1, d + 1
    recent = [*recent, *times[max(done, size - limit):].tolist()][-limit:]
    return taken, [t for t in recent if int(times[-1]) - t < window]


def lock_out(times: np.ndarray, fails: np.ndarray, state: State, failures: int, duration: int) -> tuple[np.ndarray, State]:
    """Lockout: the ``failures``-th failure in a row locks for ``duration`` and resets
    the count, a success resets it, attempts while locked are refused unseen. The
    state is (failures in a row, locked until), empty when neither matters.

    Jumps from lock to lock: away from a carried streak, the next lock is the first
    place that ends a full run of failures begun after the last lock ended.
    """
    size = len(times)
    streak, locked_until = state or (0, 0)
    outcome = np.where(fails, "fail", "ok").astype(object)
    places = np.arange(size)
    run = places - np.maximum.accumulate(np.where(fails, -1, places))
    full_runs = np.flatnonzero(run >= failures)

    start = int(np.searchsorted(times, locked_until, side="left")) if locked_until else 0
    outcome[:start] = "refused"
    carried = streak
    while start < size:
        lock = None
        if carried:
            opening = start + int(np.argmin(fails[start:])) if not fails[start:].all() else size
            if carried + opening - start >= failures:
                lock = start + failures - carried - 1
        if lock is None:
            begin = opening + 1 if carried else start
            at = int(np.searchsorted(full_runs, begin + failures - 1))
            if at == len(full_runs):
                tail = size - start + carried if carried and opening == size else int(run[-1])
                streak = tail if carried else min(tail, size - start)
                return outcome, [streak, 0] if streak else []
            lock = int(full_runs[at])
        outcome[lock] = "lock"
        carried, streak, locked_until = 0, 0, int(times[lock]) + duration
        start = max(lock + 1, int(np.searchsorted(times, locked_until, side="left")))
        outcome[lock + 1 : start] = "refused"
    return outcome, [streak, locked_until] if streak or locked_until > int(times[-1]) else []


def lock_steps(times: np.ndarray, fails: np.ndarray, failures: int, duration: int) -> list[list[int]]:
    """What ``lock_out`` leaves behind a chunk, for every state it may be entered in.

    From each place on, with no failure counted, the next lock and the place where it ends are known;
    following these jumps from all places at once, each time twice as far, gives the last state. A
    locked entry begins at the first attempt at or after its end, so [bounds, streaks, locks] tell the
    exit of an entry locked until t by how many bounds lie before t. The fourth list holds the exits
    of entries with 0, 1, ... failures counted, as pairs, the last one the chunk's last time.
    """
    size, last = len(times), int(times[-1])
    places = np.arange(size + 1)
    run = places[:-1] - np.maximum.accumulate(np.where(fails, -1, places[:-1]))
    full_runs = np.flatnonzero(run >= failures)
    at = np.searchsorted(full_runs, places + failures - 1)
    locks = at < len(full_runs)
    lock = full_runs[np.minimum(at, len(full_runs) - 1)] if len(full_runs) else np.zeros(size + 1, np.int64)
    until = times[lock] + duration
    after = np.maximum(lock + 1, np.searchsorted(times, until, side="left"))
    goes_on = locks & (after < size)
    end = np.where(goes_on, after, places)
    while (end[end] != end).any():
        end = end[end]
    streaks = np.where(locks, 0, np.minimum(int(run[-1]), size - places))[end]
    ends = np.where(locks & (until > last), until, 0)[end]

    def counted(before: int) -> list[int]:
        opening = size if fails.all() else int(np.argmin(fails))
        if before + opening >= failures:
            first = failures - before - 1
            free = int(times[first]) + duration
            place = max(first + 1, int(np.searchsorted(times, free, side="left")))
            return [0, free] if place >= size and free > last else [int(streaks[place]), int(ends[place])] if place < size else [0, 0]
        return [before + size, 0] if opening == size else [int(streaks[opening + 1]), int(ends[opening + 1])]

    # No lock from before the chunk can end later than this.
    reach = int(np.searchsorted(times, int(times[0]) + duration, side="left"))
    steps = np.concatenate(([0], 1 + np.flatnonzero((np.diff(streaks[: reach + 1]) != 0) | (np.diff(ends[: reach + 1]) != 0))))
    bounds = times[np.maximum(steps - 1, 0)][1:]
    return [bounds.tolist(), streaks[steps].tolist(), ends[steps].tolist(), [x for n in range(failures) for x in counted(n)], [last]]


def lock_exit(steps: list[list[int]], state: State) -> State:
    """Exit state of a chunk with these ``lock_steps``."""
    bounds, streaks, ends, counted, (last,) = steps
    streak, locked_until = state or (0, 0)
    if locked_until > last:
        return [0, locked_until]
    if locked_until:
        at = int(np.searchsorted(bounds, locked_until, side="left"))
        streak, locked_until = streaks[at], ends[at]
    else:
        streak, locked_until = counted[2 * streak], counted[2 * streak + 1]
    return [streak, locked_until] if streak or locked_until else []


def rate_limit(
    events: DataFrame, key: str = "user_id", time: str = "ts", row_id: str = "event_id",
    limit: int = 3, window_seconds: int = 900, chunks: int | None = None,
) -> DataFrame:
    """Whether each event is accepted (1) or refused (0)."""
    placed = ordered_chunks(events, key, time, row_id, chunks=chunks)
    fold = partial(accept, limit=limit, window=window_seconds * _MICROS)
    done = fold_rows(placed, fold, T.IntegerType())
    return done.select(F.col("row_id").alias(row_id), F.col("key").alias(key), F.col("outcome").alias("accepted"))


def lockouts(
    attempts: DataFrame, failed: Column, key: str = "user_id", time: str = "ts", row_id: str = "event_id",
    failures: int = 5, lock_seconds: int = 900, chunks: int | None = None,
) -> DataFrame:
    """Outcome of each attempt: ok, fail, lock (the failure that locks) or refused."""
    placed = ordered_chunks(attempts.withColumn("_failed", failed), key, time, row_id, "_failed", chunks)
    fold = partial(lock_out, failures=failures, duration=lock_seconds * _MICROS)
    course = Course(partial(lock_steps, failures=failures, duration=lock_seconds * _MICROS), lock_exit)
    done = fold_rows(placed, fold, T.StringType(), course)
    return done.select(F.col("row_id").alias(row_id), F.col("key").alias(key), "outcome")


def _streak_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch of a chunk: runs of failures, named by the successes of their key before them in
    the chunk, and the successes of each key. A run that goes on in the next batch keeps its name."""
    last, carried = None, 0
    for b in batches:
        if b.empty:
            continue
        keyless, key, good = b["keyless"].to_numpy(), b["key"].to_numpy(), ~b["mark"].to_numpy(dtype=bool)
        opens = np.concatenate(([True], (keyless[1:] != keyless[:-1]) | (key[1:] != key[:-1])))
        starts = np.flatnonzero(opens)
        passed = np.cumsum(good)
        base = passed[starts] - good[starts]
        if last == (keyless[0], key[0]):
            base[0] -= carried
        island = passed - np.repeat(base, np.diff(np.append(starts, len(b))))
        ends = np.append(starts[1:], len(b)) - 1
        last, carried = (keyless[-1], key[-1]), int(island[-1])
        failed = np.flatnonzero(~good)
        # Between failures of one run there is neither a success nor another key.
        breaks = np.diff(island[failed]) != 0
        breaks |= np.diff(np.cumsum(opens)[failed]) != 0
        first = failed[np.concatenate(([True], breaks))] if len(failed) else failed
        final = failed[np.concatenate((breaks, [True]))] if len(failed) else failed
        at, row = b["at"].to_numpy(), b["row_id"].to_numpy()
        chunk = int(b["chunk"].iloc[0])
        yield pd.DataFrame({
            "keyless": keyless[first], "key": key[first], "chunk": chunk, "island": island[first],
            "n": np.searchsorted(failed, final) - np.searchsorted(failed, first) + 1, "successes": 0,
            "first_at": at[first], "first_id": row[first], "last_at": at[final], "last_id": row[final],
        })
        begun = np.add.reduceat(good.astype(np.int64), starts)
        yield pd.DataFrame({
            "keyless": keyless[ends], "key": key[ends], "chunk": chunk, "island": 0, "n": 0, "successes": begun,
            "first_at": at[ends], "first_id": row[ends], "last_at": at[ends], "last_id": row[ends],
        })


def failure_streaks(
    attempts: DataFrame, failed: Column, key: str = "user_id", time: str = "ts", row_id: str = "event_id",
    chunks: int | None = None,
) -> DataFrame:
    """Maximal runs of consecutive failures per key.

    A run is named by the number of successes before it. Chunks are sorted, so each one
    counts inside itself and gives its pieces of runs and its successes; only these small
    rows meet again, to shift the counts by the successes of earlier chunks.
    """
    placed = ordered_chunks(attempts.withColumn("_failed", failed), key, time, row_id, "_failed", chunks)
    whose = ("keyless", "key")
    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    counted = placed.mapInPandas(
        _streak_pieces,
        f"keyless boolean, key {types['key']}, chunk int, island bigint, n bigint, successes bigint, "
        f"first_at bigint, first_id {types['row_id']}, last_at bigint, last_id {types['row_id']}",
    )
    pieces = counted.filter("n > 0").select(
        *whose, "chunk", "island", "n", F.struct(F.col("first_at").alias("at"), F.col("first_id").alias("row_id")).alias("first"),
        F.struct(F.col("last_at").alias("at"), F.col("last_id").alias("row_id")).alias("last"),
    )
    before = Window.partitionBy(*whose).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*whose, "chunk").agg(F.sum("successes").alias("successes"))
    shifts = totals.select(*whose, "chunk", F.coalesce(F.sum("successes").over(before), F.lit(0)).alias("shift"))

    return (
        pieces.join(shifts, [*whose, "chunk"])
        .groupBy(*whose, (F.col("island") + F.col("shift")).alias("streak"))
        .agg(F.sum("n").alias("n_failures"), F.min("first").alias("first"), F.max("last").alias("last"))
        .select(
            F.when(~F.col("keyless"), F.col("key")).alias(key),
            F.col("streak").alias("n_successes_before"),
            "n_failures",
            F.col("first.row_id").alias("first_id"),
            F.col("last.row_id").alias("last_id"),
            F.timestamp_micros("first.at").cast("date").alias("first_on"),
        )
    )


def retain(events: DataFrame, days: int = 15, time: str = "ts", reference: Column | None = None) -> DataFrame:
    """Drop events older than ``days`` before the reference time, by default the newest
    event. The newest time comes from a scalar subquery over one column."""
    newest = events.agg(F.max(time)).scalar() if reference is None else reference
    return events.filter(F.col(time) >= newest - F.make_dt_interval(F.lit(days)))

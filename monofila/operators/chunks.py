"""Sequential per-key folds over ordered rows, without one task per key.

Some rules need the whole past of a key in order: an accepted event depends on
which earlier ones were accepted. Grouping by key would send a key that holds a
third of all rows to a single task. Instead the rows are range partitioned by
(key, time, id): chunks are even whatever the keys look like, and a hot key simply
spans many of them. Inside a chunk rows stream through a small fold in Arrow
batches. What crosses a chunk border is only the state of one key, so:

1. every chunk folds with an empty entry state and reports its exit state;
2. the exit of each chunk becomes the entry of the next one when the key goes on;
   chunks that hold a single key and got a different entry fold again, until no
   entry changes any more;
3. the final pass emits rows with the settled entries.

The result equals the sequential one: the first chunk of a key has the right entry
from the start and each round settles at least one more. A key that forgets its past
within a chunk settles in a round or two. A key so dense that it never does is
followed chunk by chunk: no task ever holds it and each of its chunks is read one
more time, but the rounds take their turn. The driver sees one row per chunk.

A rule that can tell what a chunk makes of every entry state it may meet (``Course``) needs no
rounds: all chunks work out their courses at once, and the states follow from one to the next
on the driver. A course with more than ``COURSE_STEPS`` steps stays where it is and its chunk folds
in its turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import monofila
from monofila.sources.storage import shared_folder

# Executors need not have the package: folds travel with the tasks.
cloudpickle.register_pickle_by_value(monofila)

State = list[int]
# (times, marks, state) -> (outcome per row, new state)
Fold = Callable[[Any, Any, State], tuple[Any, State]]


@dataclass(frozen=True)
class Course:
    """What a rule makes of a chunk: its steps as lists of integers, and how an entry state runs
    through them to the exit state."""

    steps: Callable[[np.ndarray, np.ndarray], list[list[int]]]
    exit: Callable[[list[list[int]], State], State]


#: Steps of a course that are sent to the driver.
COURSE_STEPS = 100_000
#: Rows of a chunk, about, where the session's partitions would make larger ones.
CHUNK_ROWS = 2_000_000

_SUMMARY = "chunk int, first_key string, last_key string, exit array<bigint>"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def plain(rows: DataFrame, name: str) -> Column:
    """A key or id as bigint when it is a whole number, else as text."""
    return F.col(name).cast("bigint" if isinstance(rows.schema[name].dataType, _INTEGRAL) else "string")


def required(c: Column, what: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"event without {what}"))).otherwise(c)


def ordered_chunks(rows: DataFrame, key: str, time: str, row_id: str, mark: str | None = None, chunks: int | None = None) -> DataFrame:
    """Checkpointed rows in even, sorted partitions numbered by ``chunk``.

    Every later pass must see the same borders, and range borders come from a
    sample; the checkpoint fixes them once and also cuts lineage. Rows without a key
    form one key of their own (``keyless``).
    """
    spark = rows.sparkSession
    shared_folder(spark)
    parts = chunks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CHUNK_ROWS))
    marked = F.lit(False) if mark is None else F.coalesce(F.col(mark), F.lit(False))
    some_key = plain(rows, key)
    slim = rows.select(
        some_key.isNull().alias("keyless"),
        F.coalesce(some_key, F.lit("0").cast(rows.select(some_key).schema[0].dataType)).alias("key"),
        required(F.unix_micros(F.col(time).cast("timestamp")), "time").alias("at"),
        required(plain(rows, row_id), "id").alias("row_id"),
        marked.alias("mark"),
    )
    order = ("keyless", "key", "at", "row_id")
    placed = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.withColumn("chunk", F.spark_partition_id()).checkpoint()


def _runs(batches: Iterator[pd.DataFrame], entries: dict[int, State], fold: Fold):
    """Fold each run of one key in each batch, carrying the state along the chunk."""
    key, state = None, []
    for batch in batches:
        if batch.empty:
            continue
        keyless, keys = batch["keyless"].to_numpy(), batch["key"].to_numpy()
        times, marks = batch["at"].to_numpy(), batch["mark"].to_numpy()
        borders = (keys[1:] != keys[:-1]) | (keyless[1:] != keyless[:-1])
        starts = [0, *(borders.nonzero()[0] + 1).tolist(), len(keys)]
        outcomes = []
        for a, b in zip(starts, starts[1:]):
            here = f"{keyless[a]}:{keys[a]}"
            if key is None:
                state = list(entries.get(int(batch["chunk"].iloc[0]), []))
            elif here != key:
                state = []
            key = here
            outcome, state = fold(times[a:b], marks[a:b], state)
            outcomes.append(outcome)
        first = f"{keyless[0]}:{keys[0]}"
        yield batch, outcomes, first, key, state


def _summaries(
    chunks: DataFrame, entries: dict[int, State], fold: Fold, only: list[int] | None = None
) -> dict[int, tuple[str, str, State]]:
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = first = last = None
        exit_state: State = []
        for batch, _, opening, last, exit_state in _runs(batches, entries, fold):
            if chunk is None:
                chunk, first = int(batch["chunk"].iloc[0]), opening
        if chunk is not None:
            yield pd.DataFrame({"chunk": [chunk], "first_key": [first], "last_key": [last], "exit": [exit_state]})

    # A chunk is a partition of the checkpoint, so a job over some chunks reads only those.
    summaries = chunks.mapInPandas(summarise, _SUMMARY).rdd
    found = chunks.sparkSession.sparkContext.runJob(summaries, list, partitions=only)
    return {r["chunk"]: (r["first_key"], r["last_key"], list(r["exit"])) for r in found}


def _courses(chunks: DataFrame, course: Course, only: list[int]) -> dict[int, list[list[int]]]:
    """Steps of chunks that hold one key; a chunk's times and marks are held at once."""
    most = COURSE_STEPS

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["chunk"].iloc[0], b["at"].to_numpy(), b["mark"].to_numpy(dtype=bool)) for b in batches if len(b)]
        if held:
            steps = course.steps(np.concatenate([t for _, t, _ in held]), np.concatenate([m for *_, m in held]))
            if sum(map(len, steps)) <= most:
                yield pd.DataFrame({"chunk": [int(held[0][0])], "steps": [steps]})

    found = chunks.select("chunk", "at", "mark").mapInPandas(work, "chunk int, steps array<array<bigint>>").rdd
    rows = chunks.sparkSession.sparkContext.runJob(found, list, partitions=only)
    return {r["chunk"]: [list(x) for x in r["steps"]] for r in rows}


def _follow(chunks: DataFrame, fold: Fold, course: Course) -> dict[int, State]:
    """Entry states in one round: each chunk's exit is read off its course."""
    known = _summaries(chunks, {}, fold)
    order = sorted(known)
    goes_on = {c: known[p][1] == known[c][0] for p, c in zip(order, order[1:])}
    single = [c for c in order if goes_on.get(c) and known[c][0] == known[c][1]]
    courses = _courses(chunks, course, single) if single else {}
    entries: dict[int, State] = {}
    state: State = []
    for c in order:
        entry = state if goes_on.get(c) else []
        if entry:
            entries[c] = entry
        if not entry or known[c][0] != known[c][1]:
            state = known[c][2]
        elif c in courses:
            state = course.exit(courses[c], entry)
        else:
            state = _summaries(chunks, {c: entry}, fold, [c])[c][2]
    return entries


def settle(chunks: DataFrame, fold: Fold, parallel_rounds: int = 2) -> dict[int, State]:
    """Entry state of every chunk whose first key began in an earlier one.

    The first rounds fold all open chunks at once, which settles keys that soon forget
    their past. What is open after that follows a key too dense to forget; from then on
    only the chunks with a settled predecessor fold, so each is read once more.
    """
    known = _summaries(chunks, {}, fold)
    order = sorted(known)
    before = dict(zip(order[1:], order))
    used: dict[int, State] = {}
    for turn in count():
        wanted = {
            c: known[p][2] for c, p in before.items() if known[p][1] == known[c][0] and known[p][2]
        }
        open_ = {c for c in order if known[c][0] == known[c][1] and wanted.get(c, []) != used.get(c, [])}
        if not open_:
            return wanted
        now = sorted(c for c in open_ if turn < parallel_rounds or before[c] not in open_)
        used.update({c: wanted.get(c, []) for c in now})
        known.update(_summaries(chunks, wanted, fold, now))


def fold_rows(chunks: DataFrame, fold: Fold, outcome: T.DataType, course: Course | None = None) -> DataFrame:
    """Rows as (key, row_id, outcome), each decided by its key's ordered past."""
    entries = settle(chunks, fold) if course is None else _follow(chunks, fold, course)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, outcomes, *_ in _runs(batches, entries, fold):
            yield batch[["keyless", "key", "row_id"]].assign(outcome=np.concatenate(outcomes))

    kept = [chunks.schema[c] for c in ("keyless", "key", "row_id")]
    done = chunks.mapInPandas(emit, T.StructType([*kept, T.StructField("outcome", outcome)]))
    return done.select(F.when(~F.col("keyless"), F.col("key")).alias("key"), "row_id", "outcome")

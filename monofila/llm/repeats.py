"""A bounded filter of hashes that occur at least twice: two bits per cell, hit once and again.

Every task fills a filter of its own, filters are joined segment by segment, and the bits of
cells hit again come back in one piece of at most ``MOST_CELLS`` bits. A hash whose cells were
not all hit again occurs once for certain; the converse may be wrong.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells per hash, and the largest filter in cells (one bit each when broadcast: 128 MB).
CELLS_PER_HASH, MOST_CELLS = 16, 1 << 30
#: Bytes of the filter that are joined as one group, and groups of partial filters.
SEGMENT, FAN_IN = 1 << 15, 32

_PART = "segment int, part int, once binary, again binary"


def filter_cells(hashes: int, most: int = MOST_CELLS) -> int:
    return min(most, max(SEGMENT * 8, 1 << (CELLS_PER_HASH * max(hashes, 1) - 1).bit_length()))


def switch_on(bits: np.ndarray, at: np.ndarray) -> None:
    """Set sorted, distinct bit numbers in a packed array."""
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        bits[byte[first]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)


def is_on(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def joined(once: list[bytes], again: list[bytes]) -> tuple[bytes, bytes]:
    one, two = np.zeros(len(once[0]), np.uint8), np.zeros(len(once[0]), np.uint8)
    for a, b in zip(once, again):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        two |= b | (one & a)
        one |= a
    return one.tobytes(), two.tobytes()


def repeat_filter(rows: DataFrame, size: int, cells: Callable[[pa.RecordBatch], np.ndarray], twice: bool = True) -> bytes:
    """Packed cells hit at least twice, or at all; ``cells`` gives the cells that a batch hits.
    ``size`` is a power of two."""

    def build(batches):
        once, again = np.zeros(size >> 3, np.uint8), np.zeros(size >> 3, np.uint8)
        for b in batches:
            hit, n = np.unique(cells(b), return_counts=True)
            switch_on(again, hit[(n > 1) | is_on(once, hit)])
            switch_on(once, hit)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % FAN_IN
        for i in range(0, len(once), SEGMENT):
            if once[i : i + SEGMENT].any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([i // SEGMENT], pa.int32()), "part": pa.array([part], pa.int32()),
                    "once": pa.array([once[i : i + SEGMENT].tobytes()]), "again": pa.array([again[i : i + SEGMENT].tobytes()]),
                })

    def join(group: pd.DataFrame) -> pd.DataFrame:
        one, two = joined(group["once"].tolist(), group["again"].tolist())
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "part": [0], "once": [one], "again": [two]})

    parts = rows.mapInArrow(build, _PART)
    merged = parts.groupBy("segment", "part").applyInPandas(join, _PART).groupBy("segment").applyInPandas(join, _PART)
    # Bounded: the filter has a fixed largest size.
    out = np.zeros(size >> 3, np.uint8)
    for r in merged.select("segment", "again" if twice else "once").toLocalIterator():
        out[r[0] * SEGMENT : (r[0] + 1) * SEGMENT] = np.frombuffer(r[1], np.uint8)
    return out.tobytes()

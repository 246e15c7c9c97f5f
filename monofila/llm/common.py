"""Helpers shared by the operators: reading, scratch tables, words as numpy arrays."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import monofila
from monofila.sources.storage import scratch_path

# Executors need not have the package: task functions travel with the job.
cloudpickle.register_pickle_by_value(monofila)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write once to the folder all executors share and read back: cuts lineage and survives
    lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the text (null: empty) and the named columns; other columns are ignored."""
    return docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))


def carried(batch: pa.RecordBatch, *keep: str, **new: pa.Array) -> pa.RecordBatch:
    """Columns taken over as they are (nulls and large integers stay exact) and new ones."""
    return pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | new)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def hash_below(total: int, most: int) -> int:
    """Signed 64-bit bound that about ``most`` and seldom fewer of ``total`` hashes lie below."""
    share = min(1.0, (1.05 * most + 5 * most**0.5) / max(total, 1))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


#: Ranges that a round of ``nth_lowest`` counts.
RANGES = 4_096


def nth_lowest(rows: DataFrame, column: str, n: int) -> float:
    """The value of ``column`` (doubles, no nulls) that ``n`` others stand before in ascending order. All rows
    count: each round counts them by even ranges and goes on inside the range that holds the place."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        at = F.least(F.floor((F.col(column) - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        inside = rows.filter(F.col(column).between(low, high))
        for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("at").collect():
            if n < r["n"]:
                break
            n -= r["n"]
        low, high = r["low"], r["high"]
    return low


def shipped(spark: SparkSession, model: object):
    """Broadcast of a small model, with its class, for executors without the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpacked(shared) -> object:
    return pickle.loads(shared.value)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a batch of texts: byte spans, owning text and a 64-bit hash each.

    A word is a run of bytes other than space and 0x09 to 0x0D. Equal words always have
    equal hashes; different words differ but for 64-bit chance. Memory is a small multiple
    of the batch, so callers feed slices of bounded size (``slices``).
    """

    def __init__(self, batch: list[bytes]) -> None:
        blob = b" ".join(batch)
        data = np.frombuffer(blob, dtype=np.uint8)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
        self.blob = blob
        self.data = data
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter(map(len, batch), dtype=np.int64, count=len(batch))
        self.text_ends = np.cumsum(sizes + 1)
        self.text_starts = self.text_ends - sizes - 1
        self.owner = np.searchsorted(self.text_ends, self.starts, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(batch) + 1))
        self.solid = solid

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), out=total[1:])
        shift = _powers(_INVERSE, len(data) + 1)
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mixed((total[self.ends] - total[self.starts]) * shift[self.starts] + lengths)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` words, by position of its first word (runs may cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=total[1:])
    return mixed((total[k:] - total[:-k]) * _powers(_INVERSE, n) + np.uint64(seed))


def slices(values: list[bytes], most: int = 4_000_000):
    """(from, to) ranges of at most ``most`` bytes, a longer single text alone."""
    begin = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield begin, i
            begin, size = i, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)

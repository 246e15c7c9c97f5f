"""Records of delimited text whose quoted fields may hold line breaks, read by many tasks.

Where a byte range of a file starts, nobody knows whether a quoted field is open. But every line maps
the two possible states, outside and inside a quoted field, to the state behind it, and such maps
compose. So one pass composes the maps of each range, a prefix over the ranges (one row each) gives
the state every range is entered in, and a second pass joins lines to records. What crosses a border
comes out in pieces, one or two per range, which are put together by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import monofila

# Executors need not have the package: task functions travel with the job.
cloudpickle.register_pickle_by_value(monofila)

_RANGE = "file string, start bigint, from_outside boolean, from_inside boolean, empty_outside bigint, empty_inside bigint"
_PIECE = "file string, start bigint, place int, heading boolean, record string"
#: Pieces of a range: a whole record, the end of one begun before, the begin of one that goes on, or
#: a range without any border between records.
WHOLE, END, BEGIN, MIDDLE = range(4)


def quoted_field(separator: str) -> str:
    """A well-formed quoted field together with the separator before it."""
    sep = f"\\x{ord(separator):02x}"
    return rf'(^|{sep})"(?:[^"]|"")*"(?={sep}|$)'


def leaves_open(line: Column, separator: str) -> Column:
    """Whether a line that begins outside a quoted field ends inside one: once its complete quoted
    fields are gone, a field still starts with a quote. Most lines hold none, which is told first."""
    sep = f"\\x{ord(separator):02x}"
    return line.contains('"') & F.regexp_replace(line, quoted_field(separator), "$1").rlike(rf'(^|{sep})"')


def keeps_open(line: Column, separator: str) -> Column:
    """Whether a line that begins inside a quoted field ends inside one: no quote closes the field, or
    what follows that quote opens another one."""
    sep = f"\\x{ord(separator):02x}"
    closing = rf'^(?:[^"]|"")*?"(?={sep}|$)'
    return ~line.contains('"') | ~line.rlike(closing) | leaves_open(F.regexp_replace(line, closing, ""), separator)


@dataclass(frozen=True)
class Records:
    """``rows`` has one ``record`` per record, header and blank ones included, without its line end and
    with every byte as one (Latin-1) character; ``heading`` marks the first one of a file that is not
    empty. ``blank`` counts the empty ones."""

    rows: DataFrame
    blank: int


def states(entered: bool, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """State before each line and behind the last one, True for inside. A line that ends in the same
    state wherever it begins resets it, one that turns both around flips it."""
    reset, flip = outside == inside, outside & ~inside
    flips = np.concatenate(([0], np.cumsum(flip)))
    places = np.concatenate(([-1], np.where(reset, np.arange(len(outside)), -1)))
    last = np.maximum.accumulate(places)
    base = np.where(last >= 0, outside[last] if len(outside) else False, entered)
    since = flips - np.where(last >= 0, flips[last + 1], 0)
    return base ^ (since % 2 == 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """(file, start, lines) of every range, as a task reads them one after the other."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        file, start = b.column("file").to_pylist(), b.column("start").to_numpy()
        edges = [0, *(i for i in range(1, b.num_rows) if start[i] != start[i - 1] or file[i] != file[i - 1]), b.num_rows]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            if now not in (None, (file[x], int(start[x]))):
                yield *now, pa.Table.from_batches(held)
                held = []
            now = (file[x], int(start[x]))
            held.append(b.slice(x, y - x))
    if now is not None:
        yield *now, pa.Table.from_batches(held)


def _flags(lines: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(lines.column(c).to_numpy().astype(bool) for c in ("outside", "inside", "empty"))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, start, lines in _runs(batches):
        outside, inside, empty = _flags(lines)
        ways = [states(entered, outside, inside) for entered in (False, True)]
        values = [file, start, *(bool(w[-1]) for w in ways), *(int((empty & ~w[:-1]).sum()) for w in ways)]
        names = ("file", "start", "from_outside", "from_inside", "empty_outside", "empty_inside")
        yield pa.RecordBatch.from_pydict({n: pa.array([v]) for n, v in zip(names, values)})


def records(spark: SparkSession, files: list[str], separator: str) -> Records:
    """All records of ``files``. Lines end with a line feed, before which a carriage return is dropped;
    line ends inside a field become line feeds. The driver sees one row per range of a file, which are
    as large as ``spark.sql.files.maxPartitionBytes`` allows."""
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"\r$", "")
    read = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), line.alias("line")
    ).withColumns({
        "outside": leaves_open(F.col("line"), separator), "inside": keeps_open(F.col("line"), separator), "empty": F.col("line") == "",
    })
    ranges = read.drop("line").mapInArrow(_composed, _RANGE).collect()
    entered: dict[tuple[str, int], bool] = {}
    blank, file, state = 0, None, False
    for r in sorted(ranges, key=lambda r: (r["file"], r["start"])):
        state = state and r["file"] == file
        entered[r["file"], r["start"]] = state
        blank += r["empty_inside"] if state else r["empty_outside"]
        file, state = r["file"], r["from_inside"] if state else r["from_outside"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, lines in _runs(batches):
            before = entered[file, start]
            outside, inside, _ = _flags(lines)
            state = states(before, outside, inside)
            text = lines.column("line").to_pylist()
            begins = np.flatnonzero(~state[:-1]).tolist()
            cuts = sorted({0, *begins})
            first = start == 0
            for i in range(0, len(cuts), 10_000):
                part = cuts[i : i + 10_001]
                if i + 10_000 >= len(cuts):
                    part = [*part, len(text)]
                pieces = ["\n".join(text[x:y]) for x, y in zip(part, part[1:])]
                places = [WHOLE] * len(pieces)
                if i == 0 and before:
                    places[0] = END
                if part[-1] == len(text) and state[-1]:
                    places[-1] = MIDDLE if places[-1] == END else BEGIN
                heading = [False] * len(pieces)
                if first and (full := next((k for k, piece in enumerate(pieces) if piece), None)) is not None:
                    heading[full], first = True, False
                yield pa.RecordBatch.from_pydict({
                    "heading": pa.array(heading), "file": pa.array([file] * len(pieces)), "start": pa.array([start] * len(pieces), pa.int64()),
                    "place": pa.array(places, pa.int32()), "record": pa.array(pieces, pa.string()),
                }).select(["file", "start", "place", "heading", "record"])

    pieces = read.select("file", "start", "line", "outside", "inside", "empty").mapInArrow(join, _PIECE)
    whole = pieces.filter(F.col("place") == WHOLE).select("heading", "record")
    # A piece belongs to the last begin before it; a record that the file's end cuts short stays as it is.
    order = Window.partitionBy("file").orderBy("start", F.col("place") == BEGIN)
    crossing = pieces.filter(F.col("place") != WHOLE).withColumn("n", F.sum((F.col("place") == BEGIN).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "record")))
    joined = F.array_join(F.transform("parts", lambda x: x["record"]), "\n")
    stitched = crossing.groupBy("file", "n").agg(F.max("heading").alias("heading"), parts.alias("parts")).select("heading", joined.alias("record"))
    return Records(whole.unionByName(stitched), blank)

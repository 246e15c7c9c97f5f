"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of ``BLOCK`` bytes. Time is a row of slots, one block
each. Were blocks divisible, all sources that have blocks left would be served at once, in
proportion to their weights. A block is released at the slot in which it would then begin and
due by the end of the slot in which it would end. Serving the released block that is due first
meets every deadline, because the divisible service fits these windows. Every source then
stays within one block of its share at all times, and a source that has run dry leaves its
share to the others, so every block gets a slot.

``in_mix`` marks what lies before the first source runs dry, where the target weights hold.

Weights are whole numbers, ``FINEST`` at least for the smallest, and windows are exact. The
driver works the order out block by block, from weights and numbers of blocks alone, and
writes it out in pieces; documents look their block up. A source's documents are laid out in
blocks by parts of about ``PART`` documents, picked by a hash of the id, so a source with a
third of all rows is many parts, none of which a task must hold in order with the others. A
part begins at the byte where the one before ended, so only a source's last block is not full.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monofila.llm.common import scratch

BLOCK, PART = 65_536, 1_000
#: Sources whose table is sent to every task; a longer one is joined by shuffle.
MOST_SOURCES = 4_096
#: Units into which the weights are divided, at least; more where the smallest would get less
#: than FINEST of them.
PERIOD, FINEST = 1_024, 1 << 20
#: Slots of the schedule that are written at once.
PIECE = 1 << 20
#: Target weight: bytes of the source to this power.
TEMPERATURE = 0.7


def units(weights: list[float], period: int) -> list[int]:
    """Whole slots per period in proportion to the weights, at least one each."""
    total, spare = sum(map(Fraction, weights)), period - len(weights)
    exact = [Fraction(w) * spare / total for w in weights]
    whole = [int(x) for x in exact]
    left = spare - sum(whole)
    by_rest = sorted(range(len(weights)), key=lambda i: (whole[i] - exact[i], i))
    for i in by_rest[:left]:
        whole[i] += 1
    return [x + 1 for x in whole]


class Fluid:
    """Service of all sources at once: by virtual time v a source has been given
    min(blocks, weight * v), so all of them together are at slot ``at(v)``."""

    def __init__(self, blocks: list[int], weights: list[int]) -> None:
        ends: dict[Fraction, list[int]] = {}
        for n, w in zip(blocks, weights):
            dry = ends.setdefault(Fraction(n, w), [0, 0])
            dry[0], dry[1] = dry[0] + n, dry[1] + w
        order = sorted(ends)
        self.ends = [float(v) for v in order]
        #: (blocks of the sources that are dry, weight of the others) before, between and after the ends.
        self.lines = [(0, sum(weights))]
        for v in order:
            done, left = self.lines[-1]
            self.lines.append((done + ends[v][0], left - ends[v][1]))
        #: Slots before the first source is dry.
        self.level = -(-self.lines[0][1] * order[0].numerator // order[0].denominator) if order else 0

    def at(self, j: int, weight: int) -> int:
        """Slot, times ``weight``, by which a source of that weight has been given j blocks. The
        curve is concave, so it is the least of its lines; only those near v can be that."""
        v = j / weight
        low, high = bisect_left(self.ends, v * (1 - 1e-12)), bisect_right(self.ends, v * (1 + 1e-12))
        return min(done * weight + left * j for done, left in self.lines[low : high + 1])


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of every slot, earliest deadline first."""
    fluid = Fluid(blocks, weights)

    def due(s: int, j: int) -> int:
        return -(-fluid.at(j + 1, weights[s]) // weights[s])

    released, given = [0] * len(blocks), [0] * len(blocks)
    ready = [(due(s, 0), s) for s, n in enumerate(blocks) if n]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (due(s, given[s]), s))
        deadline, s = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("windows that a divisible service fits meet every deadline")
        j = given[s]
        yield s, j, released[s], deadline
        given[s] = j + 1
        if j + 1 < blocks[s]:
            released[s] = fluid.at(j + 1, weights[s]) // weights[s]
            heapq.heappush(waiting, (released[s], s))


def period_slots(shares: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period, earliest deadline first."""
    slots: list[list[int]] = [[] for _ in shares]
    for t, (s, *_) in enumerate(schedule(shares, shares)):
        slots[s].append(t)
    return slots


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
        F.col("source").cast("string").alias("source"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"),
    )


def shares(rows: DataFrame, weights: Mapping[str | None, float] | None, temperature: float, period: int, block: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """One row per source: number, blocks and parts; and (number, blocks, units of weight) of
    those with a weight, on the driver."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    known = [tuple(r) for r in totals.orderBy(F.desc("bytes"), "source").collect()]
    blocks = [max(1, -(-b // block)) for _, b, _ in known]
    if weights is None:
        wanted = [max(b, 1) ** temperature for _, b, _ in known]
    else:
        wanted = [float(weights.get(s, 0.0)) for s, _, _ in known]
    used = [i for i, w in enumerate(wanted) if w > 0]
    if used:
        smallest = Fraction(min(wanted[i] for i in used))
        period = max(period, len(used) + -(-FINEST * sum(Fraction(wanted[i]) for i in used) // smallest))
    share = units([wanted[i] for i in used], period) if used else []
    out = [(s, i, blocks[i], max(1, -(-n // PART))) for i, (s, _, n) in enumerate(known)]
    sources = rows.sparkSession.createDataFrame(out, "_source string, number bigint, blocks bigint, parts int")
    return sources, [(i, blocks[i], x) for i, x in zip(used, share)]


def timetable(spark: SparkSession, supply: list[tuple[int, int, int]]) -> tuple[DataFrame, int]:
    """(number, j, slot, release, deadline) of every block of sources (number, blocks, weight),
    and the slots before the first source is dry. Only ``PIECE`` slots at a time are held."""
    numbers, blocks, weights = [list(x) for x in zip(*supply)] or [[], [], []]
    names = ["number", "j", "release", "deadline"]
    pieces, piece, slot = [], [array("q") for _ in names], 0

    def written() -> DataFrame:
        columns = {c: pa.array(x, pa.int64()) for c, x in zip(names, piece)}
        at = pa.array(range(slot - len(piece[0]), slot), pa.int64())
        return scratch(spark.createDataFrame(pa.table(columns | {"slot": at})), "timetable")

    for s, *rest in schedule(blocks, weights):
        for column, x in zip(piece, (numbers[s], *rest)):
            column.append(x)
        slot += 1
        if len(piece[0]) == PIECE:
            pieces.append(written())
            piece = [array("q") for _ in names]
    if piece[0] or not pieces:
        pieces.append(written())
    return reduce(DataFrame.unionByName, pieces), Fluid(blocks, weights).level


def placed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = TEMPERATURE,
           block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """One row per input row: doc_id, key, source, size, block, release, deadline, slot, start
    (byte within the block), in_mix.

    ``weights`` maps sources (None: no source) to targets; by default a source weighs its bytes
    to the power ``temperature``. A source of weight 0, or not in ``weights``, is never in the mix
    and has no slot. Every other document has one, also behind the end of the mix. Null text has
    no bytes, a null doc_id is kept, equal rows lie side by side, an empty table gives none;
    other columns are ignored.
    """
    rows = scratch(sized(docs), "sizes")
    sources, supply = shares(rows, weights, temperature, period, block)
    sources = scratch(sources, "sources")
    few = sources.count() <= MOST_SOURCES
    labelled = rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = labelled.withColumn("_part", F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")).cast("int"))
    sums = dealt.groupBy("number", "_part").agg(F.sum("size").alias("bytes"))
    before = W.partitionBy("number").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = scratch(sums.withColumn("first", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "parts")
    times, end = timetable(rows.sparkSession, supply)
    inside = W.partitionBy("number", "_part").orderBy("doc_id", "key").rowsBetween(W.unboundedPreceding, -1)
    laid = dealt.drop("parts").withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offset = F.col("first") + F.col("_at")
    # Texts without bytes behind a full last block count to it.
    j = laid.join(starts.select("number", "_part", "first"), ["number", "_part"]).withColumn(
        "j", F.least(F.floor(offset / block), F.col("blocks") - 1).cast("bigint")
    )
    return j.join(times, ["number", "j"], "left").select(
        "doc_id", "key", "source", "size", F.col("j").alias("block"), "release", "deadline", "slot",
        (offset - F.col("j") * block).alias("start"), F.coalesce(F.col("slot") < F.lit(end), F.lit(False)).alias("in_mix"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, block, release, deadline, slot, start, in_mix of every document."""
    return placed(docs).drop("key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` in the order of their slots."""
    order = placed(docs).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("slot").alias("__slot"), F.col("start").alias("__start")
    ).groupBy("__id", "__key").agg(F.min("__slot").alias("__slot"), F.min("__start").alias("__start"))
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = rows["doc_id"].cast("bigint").eqNullSafe(order["__id"]) & (rows["__hash"] == order["__key"])
    return rows.join(order, on).repartitionByRange("__slot", "__start", "__id").sortWithinPartitions("__slot", "__start", "__id").select(*[rows[c] for c in docs.columns])

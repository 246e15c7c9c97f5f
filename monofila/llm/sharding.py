"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Every row has a sort key (64-bit hash of its text, doc_id), so equal texts lie side by side.
Shard borders are found by probing: exact bytes are summed below equally spaced candidate
keys, each wanted border is narrowed to the one interval that holds it, and only rows in
these few intervals are probed again, until an interval is within the tolerance or holds one
key. A text with a third of all rows has one hash; its interval is probed by doc_id, so it is
split as finely as any other. Rows move once, after the borders are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monofila.llm.common import scratch

#: Candidate keys per wanted border and round.
PROBES = 256
#: A border may miss its ideal place by this share of a shard.
TOLERANCE = 0.001
#: Rows numbered together when slots are given out, about.
NUMBERED = 100_000
_LOWEST = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (h, d) of every row; texts stay behind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("d"),
    )


@dataclass
class Interval:
    """Rows between two probes: where they lie and how many bytes come before and in it."""

    low_h: int
    high_h: int
    low_d: int
    high_d: int
    before: int
    size: int

    @property
    def one_hash(self) -> bool:
        return self.low_h == self.high_h

    def holds(self) -> Column:
        inside = F.col("h").between(self.low_h, self.high_h)
        return inside & F.col("d").between(self.low_d, self.high_d) if self.one_hash else inside

    def probe(self) -> Column:
        """Number of the equal slice of this interval that a row lies in."""
        low, high, key = (self.low_d, self.high_d, "d") if self.one_hash else (self.low_h, self.high_h, "h")
        width = (high - low) // PROBES + 1
        # Exact and free of overflow: the difference can exceed 64 bits.
        far = F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        return F.floor(far / F.lit(width).cast("decimal(20,0)")).cast("int")


def borders(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """First key (h, d) of shard 1, 2, ...; rows before it belong to the shards below.

    The driver sees at most (shards - 1) * PROBES sums a round, whatever the input.
    """
    whole = rows.agg(F.sum("size"), F.min("h"), F.max("h"), F.min("d"), F.max("d")).first()
    if whole[0] is None:
        return []
    total, start = whole[0], Interval(*whole[1:], 0, whole[0])
    ideal = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    open_at = {i: start for i in ideal}
    found: dict[int, tuple[int, int]] = {}
    while open_at:
        spots = list({id(v): v for v in open_at.values()}.values())
        which, probe = F.lit(None).cast("int"), F.lit(None).cast("int")
        for n, s in enumerate(spots):
            which, probe = F.when(s.holds(), n).otherwise(which), F.when(s.holds(), s.probe()).otherwise(probe)
        sums = (
            rows.select(which.alias("spot"), probe.alias("probe"), "size", "h", "d").filter("spot IS NOT NULL")
            .groupBy("spot", "probe")
            .agg(F.min("h"), F.max("h"), F.min("d"), F.max("d"), F.sum("size"), F.min(F.struct("h", "d")))
            .orderBy("spot", "probe").collect()
        )
        parts: dict[int, list[tuple[Interval, tuple[int, int]]]] = {n: [] for n in range(len(spots))}
        for r in sums:
            before = parts[r[0]][-1][0].before + parts[r[0]][-1][0].size if parts[r[0]] else spots[r[0]].before
            parts[r[0]].append((Interval(r[2], r[3], r[4], r[5], before, r[6]), tuple(r[7])))
        still = {}
        for i, spot in open_at.items():
            mine = parts[next(n for n, s in enumerate(spots) if s is spot)]
            at = max((n for n, (p, _) in enumerate(mine) if p.before <= ideal[i]), default=0)
            inside, first = mine[at]
            single = inside.one_hash and inside.low_d == inside.high_d
            if single or inside.size <= slack:
                nearer_end = at + 1 < len(mine) and inside.before + inside.size - ideal[i] < ideal[i] - inside.before
                if nearer_end:
                    first = mine[at + 1][1]
                found[i] = first
            else:
                still[i] = inside
        # Intervals that several borders share are probed once.
        same: dict[tuple, Interval] = {}
        open_at = {i: same.setdefault((v.low_h, v.high_h, v.low_d, v.high_d), v) for i, v in still.items()}
    return [found[i] for i in range(1, shards)]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of borders at or below a row's key."""
    passed = F.lit(0)
    for h, d in cuts:
        passed = passed + ((F.col("h") > h) | ((F.col("h") == h) & (F.col("d") >= d))).cast("int")
    return passed


def slotted(rows: DataFrame, count: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows of a shard are numbered in blocks picked by a hash of their key, so no task sorts a
    whole shard; a block's first number is the count of the blocks before it.
    """
    blocks = max(1, count // NUMBERED)
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("d", "h"), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_rows"))
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy("shard", "_block").orderBy("h", "d", "size", "text_crc32")
    return (
        dealt.withColumn("_n", F.row_number().over(inside)).join(starts, ["shard", "_block"])
        .withColumn("slot", F.col("_first") + F.col("_n") - 1)
    )


def byte_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards of near equal bytes.

    Null text counts as empty, a null doc_id as the lowest. Rows alike in text and doc_id have
    one key and stay together. An empty table gives no rows. Shards differ by at most the
    tolerance and the largest row at either border. Other columns are ignored.
    """
    rows = scratch(keyed(docs), "shard-keys")
    cuts = borders(rows, shards)
    placed = rows.withColumn("shard", shard_of(cuts))
    return slotted(placed, rows.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

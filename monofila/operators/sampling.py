"""Reproducible random operators: cohort split, weighted draw, duplicate injection.

Randomness is a keyed hash, so a rerun, a retried task or another engine gets the
same draw. Exact cuts need ranks; these come from counts per hash bucket plus a rank
inside buckets, never from one global sort in one task. Buckets are even because a
hash of distinct keys is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monofila.sources.storage import write_scratch

HASH_BITS = 60
BUCKET_BITS = 12
#: Rows of a bucket that one task may rank.
RANKED = 1_000_000


def keyed_hash(seed: str, *keys: Column | str) -> Column:
    """Uniform 60-bit integer from a seed and a key."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("bigint")


def uniform(seed: str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return keyed_hash(seed, *keys) / F.lit(float(2**HASH_BITS))


def weighted_draw(seed: str, weights: Sequence[tuple[str, float]], *keys: Column | str) -> Column:
    """One of the given values with probability proportional to its weight."""
    total, reached, u = sum(w for _, w in weights), 0.0, uniform(seed, *keys)
    drawn: Column | None = None
    for value, weight in weights[:-1]:
        reached += weight
        drawn = (F if drawn is None else drawn).when(u < reached / total, value)
    last = F.lit(weights[-1][0])
    return last if drawn is None else drawn.otherwise(last)


def _bucketed(rows: DataFrame, seed: str, keys: Sequence[str]) -> DataFrame:
    hashed = rows.withColumn("_hash", keyed_hash(seed, *keys))
    return hashed.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS).cast("int"))


def _offsets(bucketed: DataFrame, *groups: str) -> DataFrame:
    """Rows before each bucket; at most 2**12 rows per group."""
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_size"))
    ordered = Window.partitionBy(*groups).orderBy("_bucket")
    before = F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("_size").over(Window.partitionBy(*groups))
    return counts.select(*groups, "_bucket", "_size", F.coalesce(before, F.lit(0)).alias("_before"), size.alias("_total"))


def numbered(rows: DataFrame, seed: str, keys: Sequence[str], group: str) -> DataFrame:
    """Random order 0, 1, 2, ... within each group.

    The offsets join on the keys the rows are partitioned by for ranking, so rows move
    once, and a group that holds most rows is spread over all buckets.
    """
    bucketed = _bucketed(rows, seed, keys)
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_hash", *keys))
    placed = bucketed.withColumn("_inside", inside).join(_offsets(bucketed, group), [group, "_bucket"])
    rank = (F.col("_before") + F.col("_inside") - 1).alias("rank")
    return placed.select(*rows.columns, rank, F.col("_total").alias("group_size"))


def split_cohorts(rows: DataFrame, seed: str, keys: Sequence[str], cohorts: Sequence[tuple[str, float]], rest: str) -> DataFrame:
    """Disjoint cohorts of exact size in column ``cohort``.

    Each cohort takes the whole part of its share of what is left; ``rest`` takes the
    remainder. Only the buckets that a cut runs through are looked at again, all other rows
    are decided where they are. A cut bucket that would still be large is cut finer, by the
    next bits of the hash, until what must be ranked is small. The broadcast side has at most
    2**12 rows per cut, whatever the data.
    """
    total = rows.count()
    cuts, taken, left = [], 0, total
    for _, share in cohorts:
        size = math.floor(left * share)
        taken, left = taken + size, left - size
        cuts.append(taken)

    def cohort(place: Column) -> Column:
        chosen: Column | None = None
        for (name, _), cut in zip(cohorts, cuts):
            chosen = (F if chosen is None else chosen).when(place < cut, name)
        return F.lit(rest) if chosen is None else chosen.otherwise(rest)

    undecided = rows.withColumns({"_hash": keyed_hash(seed, *keys), "_bucket": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")})
    decided = []
    for level in range(1, HASH_BITS // BUCKET_BITS + 1):
        finer = undecided.withColumnsRenamed({"_bucket": "_parent", "_before": "_from"}).withColumn(
            "_bucket", F.shiftright("_hash", HASH_BITS - level * BUCKET_BITS)
        )
        sizes = finer.groupBy("_parent", "_from", "_bucket").agg(F.count("*").alias("_size"))
        earlier = Window.partitionBy("_parent").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("_before", F.col("_from") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        bounds = placed.select(
            "_bucket", "_before", cohort(F.col("_before")).alias("_low"), cohort(F.col("_before") + F.col("_size") - 1).alias("_high")
        )
        tagged = finer.drop("_parent", "_from").join(F.broadcast(bounds), "_bucket")
        decided.append(tagged.filter("_low = _high").select(*rows.columns, F.col("_low").alias("cohort")))
        undecided = tagged.filter("_low <> _high").select(*rows.columns, "_hash", "_bucket", "_before")
        if total >> level * BUCKET_BITS <= RANKED:
            break
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *keys))
    ranked = undecided.withColumn("_inside", inside).select(
        *rows.columns, cohort(F.col("_before") + F.col("_inside") - 1).alias("cohort")
    )
    return reduce(DataFrame.unionByName, [*decided, ranked])


def split_counts(rows: DataFrame, seed: str, keys: Sequence[str], counts: Sequence[tuple[str, int]], group: str) -> DataFrame:
    """Disjoint cohorts of the given sizes per group; rows beyond them are left out.
    Asking for more rows than a group has is an error raised by the job."""
    needed, reached, chosen = sum(n for _, n in counts), 0, None
    ranked = numbered(rows, seed, keys, group)
    for name, n in counts:
        reached += n
        chosen = (F if chosen is None else chosen).when(F.col("rank") < reached, name)
    short = F.col("group_size") < needed
    told = F.concat(F.lit(f"{needed} rows asked for, only "), F.col("group_size").cast("string"))
    cohort = F.when(short, F.raise_error(told)).otherwise(chosen)
    return ranked.select(*rows.columns, cohort.alias("cohort")).filter(F.col("cohort").isNotNull())


def inject_duplicates(
    rows: DataFrame, seed: str, key: str, person: str, channel: str,
    multi_rate: float = 0.012, internal_rate: float = 0.06,
) -> DataFrame:
    """Give a share of each channel's rows the person of a row in another channel, and
    a further, disjoint share the person of a row in the same channel.

    Donors are drawn with replacement from the rows as they were. Column ``injected``
    says what happened: multi, internal or NULL.
    """
    ranked = write_scratch(numbered(rows, seed, [key], channel), "numbered")
    # One row per channel, a closed set: where each other channel starts in its pool.
    sizes = [(r[channel], r["n"]) for r in ranked.groupBy(channel).agg(F.count("*").alias("n")).orderBy(channel).collect()]
    slots, pools = [], []
    for own, _ in sizes:
        start, parts = 0, []
        for other, size in sizes:
            if other != own:
                parts.append(F.struct(F.lit(other).alias("other"), F.lit(start).alias("start"), F.lit(start + size).alias("end")))
                start += size
        slots += [F.lit(own), F.array(*parts)]
        pools += [F.lit(own), F.lit(start)]

    n = F.col("group_size")
    several = F.lit(len(sizes) > 1)
    multi = F.floor(n * F.lit(multi_rate)).cast("bigint")
    internal = multi + F.floor(n * F.lit(internal_rate)).cast("bigint")
    kind = F.when(several & (F.col("rank") < multi), "multi").when(
        (F.col("rank") >= multi) & (F.col("rank") < internal), "internal"
    )
    drawn = ranked.withColumn("injected", kind).withColumn("_draw", keyed_hash(f"{seed}-donor", key))
    donor_channel, donor_rank = F.col(channel), F.col("_draw") % n
    if len(sizes) > 1:
        drawn = drawn.withColumn("_place", F.col("_draw") % F.try_element_at(F.create_map(*pools), F.col(channel)))
        own_slots = F.try_element_at(F.create_map(*slots), F.col(channel))
        slot = F.filter(own_slots, lambda x: (F.col("_place") >= x["start"]) & (F.col("_place") < x["end"]))[0]
        from_other = F.col("injected") == "multi"
        donor_channel = F.when(from_other, slot["other"]).otherwise(donor_channel)
        donor_rank = F.when(from_other, F.col("_place") - slot["start"]).otherwise(donor_rank)

    chosen = drawn.filter(F.col("injected").isNotNull()).withColumns({"_from": donor_channel, "_at": donor_rank})
    donors = ranked.select(F.col(channel).alias("_from"), F.col("rank").alias("_at"), F.col(person).alias("_person"))
    replaced = chosen.join(donors, ["_from", "_at"]).withColumn(person, F.col("_person"))
    kept = drawn.filter(F.col("injected").isNull())
    return kept.select(*rows.columns, "injected").unionByName(replaced.select(*rows.columns, "injected"))

"""Distinct persons that re-aggregate: exact bitmaps over numbered person keys.

A distinct count cannot be summed over channels or months. Here every person gets a number
once, and each group keeps the set of its numbers in buckets of 32,768 bits. The sets of a
coarser group are the union of the finer ones, so any level of a report comes from the stored
bitmaps and no level reads the filings again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monofila.sources.storage import write_scratch


def person_bitmaps(filings: DataFrame, *dims: str, key: str = "person_key") -> DataFrame:
    """Per group of ``dims`` and bucket the persons in it, as ``persons``. Filings without a key
    count for nobody.

    One shuffle by person, after each task has reduced a person to the groups it appears in: at
    most one entry per group, however many filings. Numbers are given in key order inside a
    partition, so a task that runs again gives the same ones, and they are dense, so that
    buckets fill up.
    """
    seen = filings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct(*dims)).alias("groups"))
    numbered = seen.sortWithinPartitions(key).select(F.monotonically_increasing_id().alias("number"), "groups")
    placed = numbered.select("number", F.inline("groups"))
    return placed.groupBy(*dims, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("persons")
    )


def distinct_persons(bitmaps: DataFrame, *dims: str) -> DataFrame:
    """Distinct persons per group of ``dims``, any of those the bitmaps were built over."""
    merged = bitmaps.groupBy(*dims, "bucket").agg(F.bitmap_or_agg("persons").alias("persons"))
    return merged.groupBy(*dims).agg(F.coalesce(F.sum(F.bitmap_count("persons")), F.lit(0)).alias("n_persons"))


def persons_rollup(bitmaps: DataFrame, *dims: str) -> DataFrame:
    """Distinct persons at every level: by all ``dims``, without the last one, and so on to the
    total. ``level`` tells how many are kept; the others are NULL.

    Each level is merged from the one below it, which is written first: bitmaps are large, so
    they are neither expanded per level nor merged twice.
    """
    types = {f.name: f.dataType for f in bitmaps.schema}
    levels, below = [], bitmaps
    for kept in range(len(dims), -1, -1):
        names = dims[:kept]
        if kept < len(dims):
            below = below.groupBy(*names, "bucket").agg(F.bitmap_or_agg("persons").alias("persons"))
            below = write_scratch(below, "bitmaps")
        counted = below.groupBy(*names).agg(F.coalesce(F.sum(F.bitmap_count("persons")), F.lit(0)).alias("n_persons"))
        columns = [F.col(d) if d in names else F.lit(None).cast(types[d]).alias(d) for d in dims]
        levels.append(counted.select(F.lit(kept).alias("level"), *columns, "n_persons"))
    return reduce(DataFrame.unionByName, levels)

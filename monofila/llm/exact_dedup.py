"""Exact dedup of normalised texts with a two-pass Bloom filter.

Pass one hashes every text and builds one bounded filter with two bits per cell: hit once,
hit again. A row whose cells were all hit again may have a twin; every other row is proven
unique. Pass two probes the filter: unique rows go straight to the result, and only the
(hash, doc_id) rows of the others are shuffled and grouped. False positives cost a little
shuffle, never a wrong row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import carried, scratch, texts
from monofila.llm.repeats import MOST_CELLS, filter_cells, is_on, repeat_filter

def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def cells(digests: list[bytes], size: int) -> np.ndarray:
    """Four cells per 32-byte digest."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    return (words & np.uint64(size - 1)).astype(np.int64)


def exact_dedup(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest doc_id stays; a null doc_id stays
    only where all of its group are null; of rows with the same text and doc_id one stays.
    An empty table gives none; other columns are ignored.
    """
    hashed = scratch(
        texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("digest")),
        "digests",
    )
    size = filter_cells(hashed.count(), most_cells)
    found = repeat_filter(hashed.select("digest"), size, lambda b: cells(b.column("digest").to_pylist(), size))
    shared = hashed.sparkSession.sparkContext.broadcast(found)

    def probe(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            if b.num_rows:
                maybe = is_on(bits, cells(b.column("digest").to_pylist(), size)).all(axis=1)
                yield carried(b, "doc_id", "digest", maybe=pa.array(maybe))

    probed = hashed.mapInArrow(probe, "doc_id bigint, digest binary, maybe boolean")
    alone = probed.filter("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    # Equal (text, doc_id) rows travel as one with a count; a hot text is combined on the map side.
    rows = probed.filter("maybe").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = probed.filter("maybe").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Written first: a join with an aggregate on its own key cannot be split where a text is hot.
    grouped = (
        rows.join(scratch(groups, "text-groups"), "digest")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest",
        )
    )
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

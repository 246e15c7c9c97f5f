"""Token counts: huge texts as overlapping chunks, spliced where both sides agree.

Short texts are encoded whole. A text over ``chunk`` characters is cut into chunks that
overlap, every chunk is encoded on its own with offsets, wherever the cluster has room, and
neighbours are joined at the first pre-token border that both have in the overlap.

Why such a border is safe: the pre-tokeniser matches from left to right and never looks
back, so what follows a border that exists in the whole text depends on the text behind it
alone. The first chunk starts where the text does; by induction its borders are those of
the whole text as long as no match could see the chunk's end. A match that ends at b reads
at most two characters behind b (a contraction) or the start of a special token, so the last
``special + 3`` characters of a chunk prove nothing and are not used. Where no common border
exists (one word longer than the overlap), the document is encoded again with an overlap
eight times as wide, until the chunk holds all of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import carried, scratch, texts

CHUNK = 65_536
OVERLAP = 1_024
LIMIT = 1_024

_PIECE = "doc_id bigint, key bigint, n_bytes bigint, chunk bigint, start bigint, last boolean, piece string"
_CODED = (
    "doc_id bigint, key bigint, n_bytes bigint, chunk bigint, last boolean, total bigint, "
    "head map<bigint,bigint>, tail map<bigint,bigint>"
)


def loaded(definition: bytes):
    """The library's tokenizer: no truncation or padding, offsets that keep leading spaces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_str(definition.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if json.loads(definition).get("pre_tokenizer", {}).get("type") == "ByteLevel":
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def unproven(definition: bytes) -> int:
    """Characters at a chunk's end whose borders may change with what follows."""
    special = [len(t["content"]) for t in json.loads(definition).get("added_tokens") or []]
    return max(special, default=0) + 3


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, bool, str]]:
    """(number, start, last, piece) of each chunk."""
    number = start = 0
    while True:
        last = start + chunk + overlap >= len(text)
        yield number, start, last, text[start:] if last else text[start : start + chunk + overlap]
        if last:
            return
        number, start = number + 1, start + chunk


def borders(encoding) -> list[tuple[int, int]]:
    """(character, tokens before it) of each pre-token start."""
    out, before = [], None
    for i, (word, span) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != before:
            out.append((span[0], i))
            before = word
    return out


def token_counts(docs: DataFrame, definition: bytes, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``definition`` is the tokenizer's JSON; its size is fixed, so it is broadcast. Null and
    empty texts have no tokens, a null doc_id stays null, repeated rows give repeated rows,
    an empty table gives none. Other columns are ignored.
    """
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shared = rows.sparkSession.sparkContext.broadcast(definition)

    def whole(batches):
        tokenizer = loaded(shared.value)
        for b in batches:
            counts, values = [], b.column("text").to_pylist()
            for i in range(0, len(values), 128):
                counts += map(len, tokenizer.encode_batch_fast(values[i : i + 128], add_special_tokens=False))
            yield carried(b, "doc_id", "n_bytes", n_tokens=pa.array(counts, pa.int64()))

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    short = sized.filter(F.length("text") <= chunk).mapInArrow(whole, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    long = spliced(sized.filter(F.length("text") > chunk), shared, unproven(definition), chunk, overlap)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def spliced(long: DataFrame, shared, margin: int, chunk: int, overlap: int) -> DataFrame:
    """Token counts of long texts. Copies of one row are encoded each, summed up under one key and
    repeated after."""
    keyed = long.withColumn("key", F.xxhash64("text"))
    parts, todo = None, keyed
    while True:
        tried = scratch(attempt(todo, shared, margin, chunk, overlap), "token-splices")
        good = tried.filter("aligned").drop("aligned")
        parts = good if parts is None else parts.unionByName(good)
        failed = tried.filter("NOT aligned").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
        if failed.isEmpty():
            break
        again = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
        todo = keyed.join(failed, again, "left_semi")
        overlap *= 8
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select(
        "doc_id", "n_bytes", "n_tokens"
    )


def attempt(todo: DataFrame, shared, margin: int, chunk: int, overlap: int) -> DataFrame:
    """Per (doc_id, key): n_bytes, n_copies, n_tokens and whether all chunks could be joined."""

    def pieces(batches):
        for b in batches:
            for i, text in enumerate(b.column("text")):
                for number, start, last, piece in cut(text.as_py(), chunk, overlap):
                    yield carried(
                        b.slice(i, 1), "doc_id", "key", "n_bytes", chunk=pa.array([number], pa.int64()),
                        start=pa.array([start], pa.int64()), last=pa.array([last]), piece=pa.array([piece]),
                    )

    def coded(batches):
        tokenizer = loaded(shared.value)
        for b in batches:
            totals, heads, tails = [], [], []
            for r in b.select(["chunk", "start", "last", "piece"]).to_pylist():
                start, piece = r["start"], r["piece"]
                encoding = tokenizer.encode(piece, add_special_tokens=False)
                found = [(start + at, i) for at, i in borders(encoding)]
                totals.append(len(encoding))
                heads.append([x for x in found if r["chunk"] and x[0] < start + overlap])
                tails.append([x for x in found if not r["last"] and start + chunk <= x[0] <= start + len(piece) - margin])
            pairs = pa.map_(pa.int64(), pa.int64())
            yield carried(
                b, "doc_id", "key", "n_bytes", "chunk", "last",
                total=pa.array(totals, pa.int64()), head=pa.array(heads, pairs), tail=pa.array(tails, pairs),
            )

    chunks = (
        todo.select("doc_id", "key", "n_bytes", "text").mapInArrow(pieces, _PIECE)
        .repartition("doc_id", "key", "chunk").mapInArrow(coded, _CODED)
    )
    # A border between two chunks meets the tail of one and the head of the next.
    sides = F.array(
        F.struct(F.col("chunk").alias("border"), F.col("tail").alias("left"), F.lit(None).cast("map<bigint,bigint>").alias("right"),
                 F.when(F.col("last"), F.col("total")).alias("rest"), F.when(F.col("chunk") == 0, 1).alias("copy")),
        F.struct((F.col("chunk") - 1).alias("border"), F.lit(None).cast("map<bigint,bigint>").alias("left"), F.col("head").alias("right"),
                 F.lit(None).cast("bigint").alias("rest"), F.lit(None).cast("int").alias("copy")),
    )
    met = (
        chunks.select("doc_id", "key", "n_bytes", F.explode(sides).alias("s")).filter("s.border >= 0")
        .groupBy("doc_id", "key", "s.border")
        .agg(F.max("n_bytes").alias("n_bytes"), F.any_value("s.left", True).alias("left"),
             F.any_value("s.right", True).alias("right"), F.max("s.rest").alias("rest"), F.count("s.copy").alias("copies"))
    )
    at = F.array_min(F.array_intersect(F.map_keys("left"), F.map_keys("right")))
    step = met.withColumn("at", F.when(F.col("rest").isNull(), at))
    gain = F.coalesce("rest", F.col("left")[F.col("at")] - F.col("right")[F.col("at")])
    return step.groupBy("doc_id", "key").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum("copies").alias("n_copies"), F.sum(gain).alias("n_tokens"),
        F.bool_and(gain.isNotNull()).alias("aligned"),
    )

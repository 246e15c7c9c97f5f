"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has 64 symbols of 12 bits, one per hash function, cut into 13 chunks
of 5 symbols. Two signatures that differ in 25 symbols at most have, by the pigeonhole rule, a
chunk with at most one difference. So every chunk is indexed once per symbol left out:
sharing one of these 64 keys is certain for all pairs under that distance (at similarity 0.8
all chunks have two differences about three times in a hundred million). Beside it each set
has 2,048 parities, one bit flipped per shingle: two sets differ in at least as many shingles
as their parities in bits, which rules pairs out without error. Every link is then confirmed
on the full shingle sets.

Components need far fewer links than there are similar pairs, so no group is expanded:

1. documents with equal sets become one class, represented by the smallest doc_id;
2. star rounds: in each key, members are compared with the smallest member only;
3. residual round: in each key, members that still lie in different components are compared,
   each pair in the first chunk and key it shares. Pairs inside one component can add
   nothing, so this leaves no link out.

Keys that a third of all documents share are joined, never grouped into one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import Words, carried, grams, mixed, scratch, slices, texts, utf8
from monofila.llm.components import components

SYMBOLS, BITS, CHUNK, CHUNKS = 64, 12, 5, 13
PARITIES = 2_048
#: Linked when 100 * intersection >= PERCENT * union of sets of SHINGLE words.
SHINGLE, PERCENT = 3, 85
STAR_ROUNDS = 2

_C = [f"c{i}" for i in range(CHUNKS)]
_P = [f"p{i}" for i in range(PARITIES // 64)]
_LONGS = ", ".join(f"{c} bigint" for c in _C + _P)
_FACTORS = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(batch: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first index per text): each text's distinct shingles, sorted. A text with
    fewer than ``k`` words has one, made of them all."""
    words = Words(batch)
    hashes = words.hashes(lower=True)
    count = np.diff(words.first)
    full = grams(hashes, k)
    inside = words.owner[k - 1 :] == words.owner[: len(hashes) - k + 1] if len(hashes) >= k else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    owners, values = [words.owner[at]], [full[at]]
    for size in range(1, k):
        few = np.flatnonzero(count == size)
        if len(few):
            owners.append(few)
            values.append(grams(hashes, size, size)[words.first[few]])
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(batch) + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Packed symbols and parities of every text (zero for those without shingles)."""
    n = len(first) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    parity = np.zeros((n, len(_P)), dtype=np.uint64)
    out = {c: np.zeros(n, dtype=np.uint64) for c in _C}
    if len(full):
        bit = mixed(value + np.uint64(3)) % np.uint64(PARITIES)
        owner = np.repeat(np.arange(n), np.diff(first))
        np.bitwise_xor.at(parity, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        for i, factor in enumerate(_FACTORS):
            low = mixed(np.minimum.reduceat(value * factor, first[full]))
            out[_C[i // CHUNK]][full] |= (low >> np.uint64(64 - BITS)) << np.uint64(BITS * (i % CHUNK))
    return out | {p: parity[:, i] for i, p in enumerate(_P)}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size, a 128-bit fingerprint of the set and the signature."""

    def run(batches):
        for b in batches:
            values = utf8(b)
            for i, j in slices(values, 1_000_000):
                value, first = shingle_sets(values[i:j], k)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(value + np.uint64(s)), dtype=np.uint64))) for s in (1, 2)]
                marks = {f"f{m}": _signed(t[first[1:]] - t[first[:-1]]) for m, t in enumerate(sums)}
                packed = {c: _signed(x) for c, x in signatures(value, first).items()}
                yield carried(b.slice(i, j - i), "doc_id", n=pa.array(np.diff(first), pa.int64()), **marks, **packed)

    return docs.mapInArrow(run, f"doc_id bigint, n bigint, f0 bigint, f1 bigint, {_LONGS}")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, chunk, dropped, id): every chunk without each of its symbols in turn."""

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for c in range(CHUNKS):
                symbols = min(CHUNK, SYMBOLS - c * CHUNK)
                chunk = b.column(_C[c]).to_numpy().view(np.uint64)
                for drop in range(symbols):
                    left = chunk & ~np.uint64(((1 << BITS) - 1) << (BITS * drop))
                    key = mixed(left ^ _FACTORS[c * CHUNK + drop])
                    yield pa.RecordBatch.from_pydict({
                        "key": _signed(key), "chunk": pa.array(np.full(len(left), c, np.int32)),
                        "dropped": pa.array(np.full(len(left), drop, np.int32)), "id": ids,
                    })

    return classes.select("id", *_C).mapInArrow(run, "key bigint, chunk int, dropped int, id bigint")


def differing(a: Column, b: Column) -> Column:
    """Symbols in which two chunks differ. Adding the low bits of each symbol to themselves
    carries into its top bit unless all are equal; chunks stay below 2 ** 63."""
    top = sum(1 << (BITS * i + BITS - 1) for i in range(CHUNK))
    rest = sum(((1 << (BITS - 1)) - 1) << (BITS * i) for i in range(CHUNK))
    x = a.bitwiseXOR(b)
    return F.bit_count((x.bitwiseAND(F.lit(rest)) + F.lit(rest)).bitwiseOR(x).bitwiseAND(F.lit(top)))


def possible(percent: int, a: str = "a", b: str = "b") -> Column:
    """Sizes and parities allow a link: a pair is linked when its sets differ in at most
    (100 - percent) / (100 + percent) of their sizes together."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    odd = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in _P])
    return sizes & ((100 + percent) * odd <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def first_shared() -> Column:
    """A pair is taken in the first chunk with at most one difference, and there once."""
    d = [differing(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in _C]
    first = F.least(*[F.when(x <= 1, i).otherwise(CHUNKS) for i, x in enumerate(d)])
    here = differing(F.col("a.own"), F.col("b.own"))
    return ((F.col("a.dropped") == 0) | (here == 1)) & (F.col("a.chunk") == first)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of which some text of a and some text of b reach the similarity by
    their full sets."""

    def run(batches):
        for b in batches:
            left, right = utf8(b, "left"), utf8(b, "right")
            for i, j in slices([x + y for x, y in zip(left, right)], 1_000_000):
                sets = [np.split(v, f[1:-1]) for v, f in (shingle_sets(left[i:j], k), shingle_sets(right[i:j], k))]
                keep = []
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield carried(b.slice(i, j - i), "a", "b", link=pa.array(keep))

    texts_of = docs.select("doc_id", "text")
    joined = (
        pairs.join(texts_of.withColumnsRenamed({"doc_id": "a", "text": "left"}), "a")
        .join(texts_of.withColumnsRenamed({"doc_id": "b", "text": "right"}), "b")
    )
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint, link boolean").filter("link").select("a", "b").distinct()


def near_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and are linked with nothing. Texts of
    rows with one doc_id are linked as that id's; a row with a set that a smaller id has too takes
    that id's component, which its id's other sets do not share. A null doc_id takes
    the component of rows with the same set; without such rows it stays null and is kept. An
    empty table gives none; other columns are ignored.
    """
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketches = scratch(sketched(rows, k), "sketches")
    real = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    first = real.groupBy("f0", "f1", "n").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in _C + _P])
    classes = scratch(first, "set-classes")
    keys = index_keys(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("root")).filter("members > 1")
    # Written first: a join with an aggregate on its own key cannot be split where a key is hot.
    met = scratch(keys.join(scratch(shared.select("key", "root"), "roots"), "key"), "shared-keys")
    # Texts of every document that meets another one, once; later joins read only these.
    meeting = met.select(F.col("id").alias("doc_id")).distinct()
    # A doc_id that several rows share keeps each of its different texts.
    distinct_texts = rows.join(meeting, "doc_id").withColumn("digest", F.md5("text")).dropDuplicates(["doc_id", "digest"])
    candidates = scratch(distinct_texts.drop("digest"), "candidate-texts")
    signed = classes.select("id", "n", *_C, *_P)

    links, tested, labels = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        here = met.withColumn("component", F.col("id")) if labels is None else labelled(met, labels, "id", "component")
        if turn < STAR_ROUNDS:
            stars = here.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"), F.col("component").alias("of_b")).distinct()
            if labels is None:
                pairs = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            else:
                foreign = labelled(stars, labels, "a", "of_a").filter("of_a <> of_b")
                pairs = foreign.groupBy("b", "of_a").agg(F.min("a").alias("a")).select("a", "b")
            pairs = (
                pairs.join(signed.select(F.col("id").alias("a"), F.struct("n", *_P).alias("x")), "a")
                .join(signed.select(F.col("id").alias("b"), F.struct("n", *_P).alias("y")), "b")
                .filter(possible(percent, "x", "y")).select("a", "b")
            )
        else:
            mixed_keys = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
            own = F.element_at(F.array(*_C), F.col("chunk") + 1)
            # Values that cannot be null keep the compiled condition short enough for the JVM to
            # optimise; it is evaluated for every two members of a key.
            solid = [F.coalesce(c, F.lit(0)).alias(c) for c in ("id", "component", "chunk", "dropped", "own", "n", *_C, *_P)]
            open_rows = (
                scratch(here.join(scratch(mixed_keys.select("key"), "mixed-keys"), "key"), "open-keys")
                .join(signed, "id").withColumn("own", own).select("key", *solid)
            )
            x, y = open_rows.alias("a"), open_rows.alias("b")
            on = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
            pairs = x.join(y, on & possible(percent) & first_shared()).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = scratch(confirmed(pairs, candidates, k, percent), "confirmed")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    return whole(sketches, classes, labels)


def labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of ``column``; a node without links is its own."""
    found = labels.select(F.col("node").alias(column), F.col("component").alias("_label"))
    return rows.join(found, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


def whole(sketches: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    ids = labelled(classes.select("f0", "f1", "n", "id"), labels, "id", "component_id").drop("id")
    placed = sketches.select("doc_id", "n", "f0", "f1").join(ids, ["f0", "f1", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )

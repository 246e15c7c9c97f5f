"""Line dedup by a segment-partition edit join.

A line goes when a line that occurs earlier (by doc_id, then line number) is within its edit
distance: one edit per ``CHARS_PER_EDIT`` characters, ``EDITS`` at most. Shorter lines go when they
are equal to an earlier one. Lines without a word are left alone.

Most lines are near no other one. So each distinct line is given a few coarse keys first, hashes of its
beginning, middle and end for a range of lengths; lines within the distance share one of them. Spark
counts the keys, a bounded filter of those that occur again picks the lines that have one, and only
these lines are joined.

They are joined like this: every line is cut into EDITS + 1 even segments. Edits can
touch at most EDITS of them, so a line within the distance contains one segment unchanged. An
index holds (length, segment number, content) of each line; each line probes it with its own
substrings for every length it could match, only at the places that the edits to the left and
to the right leave possible. Both sides carry the parities of 32 counts of characters and of 64
counts of neighbouring characters: an edit flips two bits of the one and four of the other at most, so
most chance meetings, and templates filled in with other words, end in the join itself. What is left is
verified with a banded bit-parallel edit distance.

A line needs one earlier witness, not all pairs of its group. So keys that ``CROWD`` lines or more have
in common are looked at first: each of these lines is compared with the earliest one of the key alone,
and what is near it is known to go. Such lines stay in the index, as others may be near only to
them, but no two of them are paired again. A group of g near-equal lines thus makes about g pairs.

Equal lines are combined before anything is compared, on the map side first, so a line with a
third of all rows is one row. Few lines are in any pair; a bounded filter of their ids picks
these where they lie, so verifying pairs does not move the whole table again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import mixed, scratch, texts
from monofila.llm.repeats import filter_cells, is_on, repeat_filter

EDITS, SHORTEST, CHARS_PER_EDIT = 2, 1, 20
#: Lines that are compared have SHORTEST characters or more, one of which is no blank.
_SOLID = r"[^\x20\x09-\x0D]"
_LAST = 2**63 - 1
_BASE = 0xD1342543DE82EF95
_SAME_LENGTH, _GOES = 1 << 40, 1 << 41
#: Lines with one key from which on the key's earliest line is tried alone first.
CROWD = 16
#: Lengths that have their coarse segments in common; 2 * CHARS_PER_EDIT is a multiple of it.
WIDTH = 10


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits (insert, delete, replace a character) turn a into b.

    Only the 2 * most + 1 diagonals around the main one are kept, as bits of one number per
    direction of change; each character of ``b`` updates all of them at once.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    low = 0
    while low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) <= most:
        return True
    return banded(a, b, most) <= most


def banded(a: str, b: str, most: int) -> int:
    """Edit distance of ``b`` and the no shorter ``a`` where it is ``most`` or less, else more."""
    width = 2 * most + 1
    full, last = (1 << width) - 1, len(a) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + most)
    # Bit r stands for row column - most + r. Before the first column each row costs one more.
    rise, fall, score = (full << most) & full, 0, most
    for column, c in enumerate(b):
        match = (places.get(c, 0) >> column) & full
        diagonal = ((((match & rise) + rise) ^ rise) | match | fall) & full
        right, left = (fall | ~(diagonal | rise)) & full, diagonal & rise
        if column + most <= last:
            score += not diagonal >> (width - 1)
        else:
            bit = last - column + most
            score += (right >> bit & 1) - (left >> bit & 1)
        rise, fall = (left | ~((diagonal >> 1) | right)) & full, (diagonal >> 1) & right
    return score


def allowed(a: str, b: str) -> int:
    return min(EDITS, min(len(a), len(b)) // CHARS_PER_EDIT)


def compared(line: Column) -> Column:
    return (F.length(line) >= SHORTEST) & line.rlike(_SOLID)


def distinct_lines(rows: DataFrame) -> DataFrame:
    """Every line with a word, once, with the place (d, n, key) of its first occurrence."""
    lines = rows.select("d", "key", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).filter(compared(F.col("line")))
    return lines.groupBy("line").agg(F.min(F.struct("d", "n", "key")).alias("first"))


def coarse_keys(line: Column) -> Column:
    """Hashes, one of which at least is shared by two lines of CHARS_PER_EDIT characters or more within their distance.

    The longer one's range of lengths is also a range of the other, so both have keys for it with segments of
    the same size: the beginning, the end and, where two edits are allowed, a middle that lies apart from
    both. An edit in the beginning and one in the end leave the middle whole and move it by one
    character at most; each line has it at its place and one character further on.
    """
    length = F.length(line)

    def of(start: Column) -> Column:
        least, two = start - EDITS, start >= 2 * CHARS_PER_EDIT

        def key(number: int, at: Column, size: Column) -> Column:
            return F.xxhash64(F.lit(number), start, F.substring(line, at + 1, size))

        size = F.floor(least / F.when(two, 3).otherwise(2)).cast("int")
        middle = [key(2, size + move, least - 2 * size - 1) for move in (0, 1)]
        return F.concat(F.array(key(0, F.lit(0), size), key(1, length - size, size)), F.when(two, F.array(*middle)).otherwise(none))

    none = F.array().cast("array<bigint>")
    own, longer = length - length % WIDTH, length + EDITS - (length + EDITS) % WIDTH
    return F.concat(of(own), F.when(own != longer, of(longer)).otherwise(none))


#: ``mixed`` of every character of the first plane but its last, and the 64 single bits.
_MIXED = mixed(np.arange(1, 1 << 16, dtype=np.uint64))
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; a task works them out once for all of its batches."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        # A single very long batch is not kept.
        known = np.multiply.accumulate(known)
        if len(known) <= 1 << 21:
            _POWERS[base] = known
    return known[:n]


class Segments:
    """Hashes of substrings of a batch of lines, from one running polynomial sum."""

    def __init__(self, lines: pa.Array) -> None:
        self.length = pc.utf8_length(lines).to_numpy().astype(np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "")[0].as_py()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self.start = np.cumsum(self.length) - self.length
        n = len(codes)
        plain = n == 0 or codes.max() < len(_MIXED)
        letters = _MIXED[codes] if plain else mixed(codes.astype(np.uint64) + np.uint64(1))
        self.inverse = powers(pow(_BASE | 1, -1, 1 << 64), n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letters * powers(_BASE | 1, n), out=self.total[1:])
        bit = np.uint32(1) << (codes & np.uint32(31))
        self.parity = np.bitwise_xor.reduceat(bit, self.start) if len(lines) else np.zeros(0, np.uint32)
        # Any function of the two characters will do: the top six bits of a sum that wraps.
        two = codes * np.uint32(0x9E3779B1)
        two[:-1] += codes[1:] * np.uint32(0x85EBCA6B)
        two ^= two >> np.uint32(15)
        two *= np.uint32(0xC2B2AE35)
        bit = _BITS[two >> np.uint32(26)]
        if len(lines):
            bit[self.start[1:] - 1] = 0
            bit[-1:] = 0
        self.sketch = np.bitwise_xor.reduceat(bit, self.start).view(np.int64) if len(lines) else np.zeros(0, np.int64)

    def key(self, at: np.ndarray, size: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
        """Hash of (indexed length, segment number, characters ``at`` to ``at + size``)."""
        content = (self.total[at + size] - self.total[at]) * self.inverse[at]
        return mixed(content ^ mixed((length * (EDITS + 1) + number).astype(np.uint64)))


def segment(length: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of a segment; the last ones are longer by one where needed."""
    short, longer = length // (EDITS + 1), length % (EDITS + 1)
    before = np.maximum(number - (EDITS + 1 - longer), 0)
    return short * number + before, short + (number >= EDITS + 1 - longer)


def entries(lines: DataFrame, probing: bool) -> DataFrame:
    """(key, id, mark, sketch, place): index entries, or probes, which have no place. The mark holds the
    parity of characters, whether the line is known to go, and for probes whether they look for lines of
    their own length."""

    def run(batches):
        for b in batches:
            goes = b.column("goes").to_numpy(zero_copy_only=False)
            own = {c: b.column(c).to_numpy() for c in ("id", "place") if c in b.schema.names}
            for begin in range(0, b.num_rows, 2_000):
                end = begin + 2_000
                part, known = Segments(b.column("line").slice(begin, 2_000)), goes[begin:end].astype(np.int64) * _GOES
                keys, rows, flags = [], [], []

                def take(ok: np.ndarray, at, size, length, number: int, flag: int) -> None:
                    i = np.flatnonzero(ok)
                    keys.append(part.key(part.start[i] + at[i], size[i], length[i], number).view(np.int64))
                    rows.append(i)
                    flags.append(np.full(len(i), flag))

                for shorter in range(EDITS + 1 if probing else 1):
                    length = part.length - shorter
                    for number in range(EDITS + 1):
                        start, size = segment(length, number)
                        flag = _SAME_LENGTH if probing and not shorter else 0
                        if not probing:
                            take(length > 0, start, size, length, number, flag)
                            continue
                        for move in range(-number, number + 1):
                            # Edits left of the segment move it by ``number`` at most, edits right of
                            # it leave the rest for the ones still to come.
                            if abs(move - shorter) <= EDITS - number:
                                at = start + move
                                take((length > 0) & (at >= 0) & (at + size <= part.length), at, size, length, number, flag)
                i = np.concatenate(rows)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(np.concatenate(keys)), "mark": pa.array(part.parity[i].astype(np.int64) | known[i] | np.concatenate(flags)),
                    "sketch": pa.array(part.sketch[i]),
                } | {c: pa.array(x[begin:end][i]) for c, x in own.items()}).select(shape)

    shape = ["key", "id", "mark", "sketch", *([] if probing else ["place"])]
    return lines.select("id", "line", "goes", *shape[4:]).mapInArrow(run, ", ".join(f"{c} bigint" for c in shape))


def likely(x: str, y: str) -> Column:
    """Whether both parities of two entries allow EDITS edits."""
    def differ(name: str, bits: int) -> Column:
        return F.bit_count(F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}")).bitwiseAND(F.lit(bits)))

    return (differ("mark", 0xFFFFFFFF) <= 2 * EDITS) & (differ("sketch", -1) <= 4 * EDITS)


def crowd_pairs(index: DataFrame) -> DataFrame:
    """(a, b): lines of crowded keys, each with the key's earliest line only."""
    first = F.min(F.struct("place", "id", "mark", "sketch")).alias("hub")
    crowded = index.groupBy("key").agg(F.count("*").alias("n"), first).filter(F.col("n") >= CROWD).select("key", "hub.*")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & likely("x", "y")
    return crowded.alias("x").join(index.alias("y"), on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_pairs(index: DataFrame, probe: DataFrame) -> DataFrame:
    """(a, b): lines that share a segment and whose parities allow a match, but for two lines that are
    both known to go."""
    one_way = (F.col("x.id") < F.col("y.id")) | (F.col("y.mark").bitwiseAND(F.lit(_SAME_LENGTH)) == 0)
    open_ = F.col("x.mark").bitwiseAND(F.col("y.mark")).bitwiseAND(F.lit(_GOES)) == 0
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & one_way & open_ & likely("x", "y")
    return index.drop("place").alias("x").join(probe.alias("y"), on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def later_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of lines with an earlier line within their edit distance."""

    def run(batches):
        for b in batches:
            names = ("a", "b", "line_a", "line_b", "a_first")
            gone = [
                y if a_first else x for x, y, s, t, a_first in zip(*(b.column(c).to_pylist() for c in names))
                if edit_distance_within(s, t, allowed(s, t))
            ]
            yield pa.RecordBatch.from_pydict({"id": pa.array(gone, pa.int64())})

    def of(side: str) -> DataFrame:
        return lines.select(F.col("id").alias(side), F.col("line").alias(f"line_{side}"), F.col("first").alias(f"first_{side}"))

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select(
        "a", "b", "line_a", "line_b", (F.col("first_a") < F.col("first_b")).alias("a_first")
    )
    return joined.mapInArrow(run, "id bigint").distinct()


def cells(ids: pa.Array, size: int) -> np.ndarray:
    value = mixed(ids.to_numpy().astype(np.uint64))
    return np.stack([value & np.uint64(size - 1), (value >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def present(values: DataFrame):
    """Size and broadcast bits of a bounded filter of one column of integers."""
    size = filter_cells(values.count())
    bits = repeat_filter(values, size, lambda b: cells(b.column(0), size).ravel(), twice=False)
    return size, values.sparkSession.sparkContext.broadcast(bits)


def lines_of(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that occur in ``pairs`` and perhaps some others."""
    size, shared = present(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(is_on(bits, cells(b.column("id"), size)).all(axis=0)))

    return lines.mapInArrow(run, lines.schema)


def sharing_lines(lines: DataFrame) -> DataFrame:
    """The lines that have one of their ``keys`` in common with another one and perhaps some others."""
    counts = lines.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    size, shared = present(scratch(counts.filter("n > 1").select("key"), "line-keys"))

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            keys = b.column("keys")
            found = is_on(bits, cells(keys.flatten(), size)).all(axis=0)
            # Every line has keys.
            n = pc.list_value_length(keys).to_numpy()
            yield b.select(out.names).filter(pa.array(np.logical_or.reduceat(found, np.cumsum(n) - n)))

    out = lines.drop("chars", "keys").schema
    return lines.mapInArrow(run, out)


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (line numbers from 0).

    Null text counts as one empty line; a null doc_id counts as the largest; of lines that
    first occur twice in one document the upper one stays; rows alike in doc_id and text get
    the same verdict. An empty table gives none; other columns are ignored.
    """
    return judged(docs).select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")


def near_lines(lines: DataFrame) -> DataFrame:
    """Ids of lines (line, id, first, place, chars, keys) near an earlier line, once each."""
    # Shorter lines may not differ at all.
    long = scratch(sharing_lines(lines.filter(F.col("chars") >= CHARS_PER_EDIT)), "sharing-lines").withColumn("goes", F.lit(False))
    index = scratch(entries(long, False), "line-index")
    pairs = scratch(crowd_pairs(index), "crowd-pairs")
    if pairs.isEmpty():
        early = pairs.select(F.col("a").alias("id"))
    else:
        early = scratch(later_lines(pairs, scratch(lines_of(pairs, long), "crowd")), "crowded-lines")
        # What goes is marked where it lies in the index; the few hubs' lines make this side small.
        goes = F.coalesce("_goes", F.lit(False))
        known = early.withColumn("_goes", F.lit(True))
        index = index.join(known, "id", "left").withColumn("mark", F.col("mark") + F.when(goes, _GOES).otherwise(0)).drop("_goes")
        long = long.join(known, "id", "left").withColumn("goes", goes).drop("_goes")
    more = scratch(near_pairs(index, entries(long, True)), "line-pairs")
    return early.unionByName(later_lines(more, scratch(lines_of(more, long), "paired-lines"))).distinct()


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the named columns, d, key, n_lines and the removed line numbers."""
    rows = texts(docs, *keep).withColumns({
        "d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), "key": F.xxhash64("text"),
    })
    # In the order of first occurrence, as far as 43 bits of doc_id and 20 of the line number tell it.
    # The exact order decides which line of a pair goes; this one only picks whom to try first.
    place = F.least(F.greatest("first.d", F.lit(0)), F.lit(2**43 - 1)) * 2**20 + F.least("first.n", F.lit(2**20 - 1))
    # Keys are worked out once, not where they are exploded: Spark would infer a filter there that works them out
    # again. Under a condition, for long lines only, their code would be too large for the JVM to compile.
    lines = scratch(distinct_lines(rows).withColumns({
        "id": F.monotonically_increasing_id(), "place": place, "chars": F.length("line"), "keys": coarse_keys(F.col("line")),
    }), "lines")
    gone = near_lines(lines)
    kept = (
        lines.select("id", "first").join(gone, "id", "left_anti").groupBy("first.d", "first.key")
        .agg(F.collect_list("first.n").alias("kept"))
    )
    solid = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(compared(x), i).otherwise(-1))
    counted = rows.select("doc_id", *keep, "d", "key", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.filter(solid, lambda i: i >= 0).alias("solid"))
    return counted.join(kept, ["d", "key"], "left").withColumn(
        "removed", F.array_except("solid", F.coalesce("kept", F.array().cast("array<int>")))
    ).drop("solid", "kept")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines cut from ``text`` and ``n_chars`` brought up to date.
    A document that had lines of which none is left goes; one without words stays as it is."""
    verdict = judged(docs).select(F.col("d").alias("__d"), F.col("key").alias("__key"), F.col("removed").alias("__removed"))
    rows = docs.withColumns({
        "__d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), "__key": F.xxhash64(F.coalesce("text", F.lit(""))),
    })
    found = rows.join(verdict.dropDuplicates(["__d", "__key"]), ["__d", "__key"])
    cut = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(__removed, i)), '\\n')")
    changed = F.size("__removed") > 0
    out = found.withColumn("text", F.when(changed, cut).otherwise(F.col("text"))).filter(~changed | F.col("text").rlike(_SOLID))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

"""Substring dedup with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words. Words of windows that also start in a document with
a smaller doc_id are removed. Every document is a reference for all later ones, so sending
every document past the automaton of every shard would be quadratic; instead documents meet
only the shards that can hold a match:

1. each window is named by its smallest ``SEED``-word hash; equal windows have equal seeds, and
   neighbouring windows mostly share one, so a document has about one seed per 17 words;
2. seeds seen in one document only are dropped, the others fetch their context: the words of
   all windows that they name. Equal contexts are one reference with its smallest doc_id;
3. shards are runs of seeds. A shard's references are put into one suffix automaton whose
   states know the smallest doc_id of their substrings; its contexts are streamed through it
   for matching statistics, held at ``WINDOW`` words, which gives the smallest doc_id that
   holds each window;
4. overlapping windows found earlier merge into maximal spans, which are cut from the text.

A seed with more than ``CROWDED`` different contexts (a passage in countless documents) is
split: windows reaching further left get a seed extended to the left, the others one extended
to the right, half the remaining way each time. After six splits a seed is a whole window, so
equal contexts are one row. No seed is dropped and no shard outgrows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import Words, carried, grams, scratch, slices, texts, utf8

WINDOW, SEED = 50, 16
CROWDED = 1_000
#: Words of references in one automaton, about; a seed is never torn apart.
SHARD = 20_000
_LAST = 2**63 - 1


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (the first of equals) in each run of ``width``."""
    n = len(values) - width + 1
    at, span = np.arange(len(values)), 1

    def better(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(values[y] < values[x], y, x)

    while span * 2 <= width:
        at, span = better(at[: len(at) - span], at[span:]), span * 2
    return better(at[:n], at[width - span : width - span + n])


def seeds(words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (seed, its word, first window, windows), words counted in the text."""
    out = []
    gram = grams(hashes, SEED)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a < WINDOW:
            out.append((np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3)
            continue
        own = gram[a : b - SEED + 1]
        core = window_minima(own, WINDOW - SEED + 1)
        first = np.flatnonzero(np.concatenate(([True], core[1:] != core[:-1])))
        out.append((own[core[first]], core[first], first, np.diff(np.append(first, len(core)))))
    return out


def named(docs: DataFrame) -> DataFrame:
    """Per document: words, hash of all of them, and its seeds."""

    def run(batches):
        for b in batches:
            values = utf8(b)
            for i, j in slices(values, 2_000_000):
                words = Words(values[i:j])
                found = seeds(words, words.hashes())
                part = b.slice(i, j - i)
                whole = [hashlib.sha256(b" ".join(v.split())).hexdigest() for v in values[i:j]]
                seed, core, start, size = (np.concatenate([f[n] for f in found]) for n in range(4))
                # Start, core (less than a window behind it) and size (no larger) in one number.
                place = (start << 12) | ((core - start) << 6) | size
                flat = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array(place, pa.int64())], ["seed", "place"])
                ends = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])))
                yield carried(
                    part, "doc_id", "d", "key", n_words=pa.array(np.diff(words.first), pa.int64()), whole=pa.array(whole, pa.string()),
                    seeds=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                )

    shape = "doc_id bigint, d bigint, key bigint, n_words bigint, whole string, seeds array<struct<seed:bigint,place:bigint>>"
    return docs.mapInArrow(run, shape)


def contexts(candidates: DataFrame) -> DataFrame:
    """One row per seed of a document: where it lies and the words of its windows."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("d", "key", "start", "seed", "core", "size", "context")}
            for d, key, text, hits in zip(*(b.column(c).to_pylist() for c in ("d", "key")), utf8(b), b.column("hits").to_pylist()):
                words = text.split()
                for h in hits:
                    start, core, size = h["place"] >> 12, h["place"] >> 6 & 63, h["place"] & 63
                    row = (d, key, start, h["seed"], core, size, b" ".join(words[start : start + size + WINDOW - 1]))
                    for column, value in zip(out.values(), row):
                        column.append(value)
                if len(out["d"]) > 20_000:
                    yield batch_of(out)
                    out = {k: [] for k in out}
            yield batch_of(out)

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        types = {"start": pa.int32(), "core": pa.int32(), "size": pa.int32()}
        arrays = {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items() if k != "context"}
        return pa.RecordBatch.from_pydict(arrays | {"context": pa.array(out["context"], pa.binary()).cast(pa.string())})

    rows = candidates.mapInArrow(run, "d bigint, key bigint, start int, seed bigint, core int, size int, context string")
    return rows.withColumn("id", F.xxhash64("context"))


class Automaton:
    """Suffix automaton of several word sequences; states know the smallest owner."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [_LAST]

    def _state(self, next_: dict[int, int], link: int, length: int, owner: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """Copy of q for the shorter substrings that end at p's continuation."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, _LAST)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], owner: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                if self.length[q] != self.length[last] + 1:
                    q = self._split(last, word, q)
                last = q
            else:
                new = self._state({}, 0, self.length[last] + 1, _LAST)
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def settle(self) -> None:
        """Hand the smallest owner on to all shorter substrings."""
        for s in np.argsort(self.length)[:0:-1].tolist():
            up = self.link[s]
            if self.owner[s] < self.owner[up]:
                self.owner[up] = self.owner[s]

    def owners(self, words: list[int], window: int) -> list[int]:
        """Smallest owner of each run of ``window`` words (``_LAST`` where none has it)."""
        out, state, matched = [], 0, 0
        follow, link, length, owner = self.next, self.link, self.length, self.owner
        for i, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state, matched = follow[state][word], matched + 1
            while length[link[state]] >= window if state else False:
                state = link[state]
            matched = min(matched, window) if state else 0
            if i >= window - 1:
                out.append(owner[state] if matched >= window else _LAST)
        return out


def shard_answers(group: list[tuple[int, int, str, int]], window: int = WINDOW) -> Iterator[tuple[int, int, list[int]]]:
    """(seed, id, owner of each window) for one shard's (seed, id, context, first doc)."""
    numbers: dict[str, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in context.split(" ")] for _, _, context, _ in group]
    automaton = Automaton()
    for words, (_, _, _, first) in zip(coded, group):
        automaton.add(words, first)
    automaton.settle()
    for words, (seed, i, _, _) in zip(coded, group):
        yield seed, i, automaton.owners(words, window)


def answered(references: DataFrame) -> DataFrame:
    """(seed, id, at, owners) of references whose seeds are not crowded."""

    def run(batches):
        shard: list[tuple[int, int, str, int]] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows = list(shard_answers(shard))
            return pa.RecordBatch.from_pydict({
                "seed": pa.array([r[0] for r in rows], pa.int64()), "id": pa.array([r[1] for r in rows], pa.int64()),
                "at": pa.array([0] * len(rows), pa.int32()), "owners": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            })

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("seed", "id", "context", "first"))):
                if size > SHARD and row[0] != shard[-1][0]:
                    yield done()
                    shard, size = [], 0
                shard.append(row)
                size += row[2].count(" ") + 1
        if shard:
            yield done()

    dealt = references.select("seed", "id", "context", "first").repartition("seed").sortWithinPartitions("seed", "first", "id")
    return dealt.mapInArrow(run, "seed bigint, id bigint, at int, owners array<bigint>")


def halves(crowded: DataFrame) -> DataFrame:
    """Each reference as up to two with longer cores: further left, and further right."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("p_seed", "p_id", "at", "core", "length", "size", "first", "context", "seed_text")}
            names = ("seed", "id", "core", "length", "size", "first", "context")
            for seed, i, core, length, size, first, context in zip(*(b.column(c).to_pylist() for c in names)):
                words = context.split(" ")
                slack = WINDOW - length
                left = (slack + 1) // 2
                # Windows that start ``left`` words before the core, or more.
                cut = max(0, min(size, core - left + 1))
                for at, n, new_core, new_length in (
                    (0, cut, core - left, length + left), (cut, size - cut, core, length + slack - left + 1),
                ):
                    if n:
                        part = words[at : at + n + WINDOW - 1]
                        c = new_core - at
                        row = (seed, i, at, c, new_length, n, first, " ".join(part), " ".join(part[c : c + new_length]))
                        for column, value in zip(out.values(), row):
                            column.append(value)
            types = {"at": pa.int32(), "core": pa.int32(), "length": pa.int32(), "size": pa.int32()}
            yield pa.RecordBatch.from_pydict({
                k: pa.array(v, pa.string() if k in ("context", "seed_text") else types.get(k, pa.int64())) for k, v in out.items()
            })

    rows = crowded.select("seed", "id", "core", "length", "size", "first", "context").mapInArrow(
        run, "p_seed bigint, p_id bigint, at int, core int, length int, size int, first bigint, context string, seed_text string"
    )
    return rows.withColumn("seed", F.xxhash64("seed_text", "length")).withColumn("id", F.xxhash64("context")).drop("seed_text")


def judged(references: DataFrame) -> DataFrame:
    """(seed, id, at, owners): owners of the windows of each reference from window ``at`` on."""
    crowd = references.filter(F.col("length") < WINDOW).groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("seed")
    crowd = scratch(crowd, "crowded-seeds")
    if crowd.isEmpty():
        return answered(references)
    parts = scratch(halves(references.join(crowd, "seed", "left_semi")), "split-seeds")
    below = judged(scratch(distinct_references(parts), "references"))
    up = (
        parts.select("p_seed", "p_id", F.col("at").alias("_from"), "seed", "id").join(below, ["seed", "id"])
        .select(F.col("p_seed").alias("seed"), F.col("p_id").alias("id"), (F.col("_from") + F.col("at")).alias("at"), "owners")
    )
    return answered(references.join(crowd, "seed", "left_anti")).unionByName(up)


def distinct_references(rows: DataFrame) -> DataFrame:
    """One row per context of a seed with its smallest doc_id."""
    return rows.groupBy("seed", "id").agg(
        F.any_value("context").alias("context"), F.any_value("core").alias("core"), F.any_value("size").alias("size"),
        F.any_value("length").alias("length"), F.min("first").alias("first"),
    )


def cut(candidates: DataFrame) -> DataFrame:
    """n_removed and the hash of the kept words, where windows start at ``found``."""

    def run(batches):
        for b in batches:
            removed, kept = [], []
            for text, found in zip(utf8(b), b.column("found").to_pylist()):
                words = text.split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(np.asarray(found, dtype=np.int64))
                change[starts] += 1
                np.subtract.at(change, starts + WINDOW, 1)
                stay = np.cumsum(change[:-1]) == 0
                removed.append(int(len(words) - stay.sum()))
                kept.append(hashlib.sha256(b" ".join([w for w, s in zip(words, stay.tolist()) if s])).hexdigest())
            yield carried(b, "d", "key", n_removed=pa.array(removed, pa.int64()), kept_sha256=pa.array(kept, pa.string()))

    return candidates.mapInArrow(run, "d bigint, key bigint, n_removed bigint, kept_sha256 string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words; a null doc_id counts as the largest; rows with one
    doc_id never remove each other's words; an empty table gives none; other columns are
    ignored.
    """
    rows = texts(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"),
        F.xxhash64("text").alias("key"), "text",
    )
    base = scratch(named(rows), "seeds")
    each = base.select("d", "key", F.explode("seeds").alias("s")).select("d", "key", "s.*")
    shared = each.groupBy("seed").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low < high").select("seed")
    # Written first: a join with an aggregate on its own key cannot be split where a seed is hot.
    hits = each.join(scratch(shared, "shared-seeds"), "seed").groupBy("d", "key").agg(F.collect_set(F.struct("seed", "place")).alias("hits"))
    candidates = scratch(rows.select("d", "key", "text").join(hits, ["d", "key"]).dropDuplicates(["d", "key"]), "candidates")
    found = scratch(contexts(candidates), "contexts")
    start = found.withColumn("length", F.lit(SEED)).withColumn("first", F.col("d"))
    answers = judged(scratch(distinct_references(start), "references"))
    earlier = F.expr("filter(transform(owners, (o, i) -> IF(o < d, start + at + i, -1)), x -> x >= 0)")
    spans = (
        found.select("d", "key", "start", "seed", "id").join(answers, ["seed", "id"])
        .select("d", "key", earlier.alias("found")).filter("size(found) > 0")
        .groupBy("d", "key").agg(F.flatten(F.collect_list("found")).alias("found"))
    )
    changed = cut(candidates.select("d", "key", "text").join(spans, ["d", "key"]))
    return base.select("doc_id", "d", "key", "n_words", "whole").join(changed, ["d", "key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )

"""BPE encoding and decoding with contiguous rank arrays.

A word is a row of part ids with the rank of each adjacent pair beside it. The lowest rank
(leftmost of equals) is found by scanning, its boundary is deleted, and only the two ranks
next to it are looked up again, until no pair merges. Words of one length are scanned
together as a matrix, and each distinct word of a task once; words over ``SHORT`` bytes,
where scanning would be quadratic, take their pairs from a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import carried, mixed, texts

#: Longest word, in bytes, that is scanned.
SHORT = 64
#: Distinct words a task remembers; beyond, it forgets all and goes on.
REMEMBERED = 400_000

# Fixed value: the splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """Character that stands for each byte in vocabulary files: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file, equal to its library on every text."""

    def __init__(self, definition: bytes) -> None:
        file = json.loads(definition)
        vocab, symbols = file["model"]["vocab"], byte_symbols()
        special = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        size = max([*vocab.values(), *special.values()]) + 1
        self.size = size
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(symbols[c] for c in token) if token not in special else token.encode()
        for token, i in special.items():
            self.piece[i] = token.encode()
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], dtype=np.int64)
        self._index(left * size + right)
        self.split = regex.compile(PATTERN)
        self.words: dict[str, tuple[int, ...]] = {}

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing table pair key -> rank, for lookups of whole arrays."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.mask = (1 << bits) - 1
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist())):
            step = 1
            while self.slot_key[at] not in (-1, key):
                at, step = (at + 1) & self.mask, step + 1
            self.probes = max(self.probes, step)
            self.slot_key[at], self.slot_rank[at] = key, min(rank, self.slot_rank[at])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where it never merges."""
        keys = left * self.size + right
        at = self._home(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], _NONE)
        todo = np.nonzero((found != keys) & (found != -1))
        while len(todo[0]):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.slot_key[at[todo]]
            hit = found == keys[todo]
            out[tuple(t[hit] for t in todo)] = self.slot_rank[at[tuple(t[hit] for t in todo)]]
            on = ~hit & (found != -1)
            todo = tuple(t[on] for t in todo)
        return out

    def scan(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words that all have the same number of bytes."""
        out: list[tuple[int, ...]] = [()] * len(words)
        who = np.arange(len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)].reshape(len(words), -1)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(who):
            if rank.shape[1]:
                best = rank.argmin(axis=1)
                lowest = rank[np.arange(len(who)), best]
                goes_on = lowest != _NONE
            else:
                goes_on = np.zeros(len(who), dtype=bool)
            if not goes_on.all():
                for i, row in zip(who[~goes_on].tolist(), ids[~goes_on].tolist()):
                    out[i] = tuple(row)
                who, ids, rank = who[goes_on], ids[goes_on], rank[goes_on]
                if not len(who):
                    break
                best, lowest = best[goes_on], lowest[goes_on]
            # Delete the boundary behind part ``best``; every row loses exactly one part.
            here = np.arange(len(who))
            columns = np.arange(ids.shape[1] - 1)
            keep = columns + (columns > best[:, None])
            ids = np.take_along_axis(ids, keep, axis=1)
            ids[here, best] = self.merged[lowest]
            rank = np.take_along_axis(rank, keep[:, :-1] if rank.shape[1] > 1 else keep[:, :0], axis=1)
            for beside in (best - 1, best):
                ok = (beside >= 0) & (beside < rank.shape[1])
                row, at = here[ok], beside[ok]
                rank[row, at] = self.ranks(ids[row, at], ids[row, at + 1])
        return out

    def heap(self, word: bytes) -> tuple[int, ...]:
        """Ids of one long word in O(n log n)."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        queue = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r = int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r != _NONE:
                        heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)

    def learn(self, words: Iterable[str]) -> None:
        by_size: dict[int, list[str]] = {}
        coded: dict[int, list[bytes]] = {}
        for w in words:
            b = w.encode()
            if len(b) > SHORT:
                self.words[w] = self.heap(b)
            else:
                by_size.setdefault(len(b), []).append(w)
                coded.setdefault(len(b), []).append(b)
        for size, group in by_size.items():
            for i in range(0, len(group), 8_192):
                self.words.update(zip(group[i : i + 8_192], self.scan(coded[size][i : i + 8_192])))

    def parts(self, text: str) -> list[str]:
        """Pre-tokens; special strings come out whole, as the library's default has it."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for piece in self.special_split.split(text):
            out.extend([piece] if piece in self.special else self.split.findall(piece))
        return out

    def encode_batch(self, batch: list[str]) -> list[list[int]]:
        if len(self.words) > REMEMBERED or not self.words:
            self.words = {s: (i,) for s, i in self.special.items()}
        split = [self.parts(t) for t in batch]
        self.learn(set(chain.from_iterable(split)).difference(self.words))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, definition: bytes, id_type: str = "bigint") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    rows, shared = texts(docs), docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        codec = Codec(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield carried(part, "doc_id", ids=pa.array(codec.encode_batch(part.column("text").to_pylist()), pa.list_(pa.int32())))

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, definition: bytes, id_type: str = "bigint") -> DataFrame:
    """doc_id and text of every list of ids (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        codec = Codec(shared.value)
        for b in batches:
            decoded = [codec.decode(x.as_py() or ()) for x in b.column("ids")]
            yield carried(b, "doc_id", text=pa.array(decoded, pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def round_trip(docs: DataFrame, definition: bytes, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids
    where asked for.

    Nothing is shuffled. Null and empty texts have no tokens
    and the hashes of the empty string; a null doc_id stays null; repeated rows give repeated
    rows; an empty table gives none; columns of ``keep`` (bigint) are carried along, others are
    ignored. ``definition`` is the vocabulary file, of fixed size, and is broadcast.
    """
    rows = texts(docs, *keep).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shared = rows.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        codec = Codec(shared.value)
        digits = [str(i) for i in range(codec.size)].__getitem__
        sha = hashlib.sha256
        for b in batches:
            out, lists, values = [], [], b.column("text").to_pylist()
            for i in range(0, len(values), 256):
                for ids in codec.encode_batch(values[i : i + 256]):
                    if with_ids:
                        lists.append(np.array(ids, dtype=np.int32))
                    out.append((len(ids), sha(",".join(map(digits, ids)).encode()).hexdigest(), sha(codec.decode(ids).encode()).hexdigest()))
            n, ids, decoded = zip(*out) if out else ((), (), ())
            more = {"ids": pa.array(lists, pa.list_(pa.int32()))} if with_ids else {}
            yield carried(
                b, "doc_id", *keep, **more, n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()),
                decoded_sha256=pa.array(decoded, pa.string()),
            )

    ids = "ids array<int>, " if with_ids else ""
    kept = "".join(f"{c} bigint, " for c in keep)
    return rows.mapInArrow(run, f"doc_id bigint, {kept}{ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string")

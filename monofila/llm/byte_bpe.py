"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is what merging yields exactly when every two adjacent tokens are
compatible: encoding their joined bytes gives these two back. So nothing is merged at all.
Bytes are mapped to Latin-1 characters, an Aho-Corasick automaton over the vocabulary finds the
longest token from every place, and tokens are laid one after the other. Where a token does not
suit the one before it, its next shorter prefix is tried; where none is left, the place is
marked as a dead end and the token before it is taken back. A place is left at most once for
each token that begins there and dead ends are never entered again, so a word takes linear time.

Whether two tokens suit each other is decided by undoing their merges along the border, and
remembered. Ids must be ranks: a token with a lower id is merged earlier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monofila.llm.common import carried, shipped, texts, unpacked

#: Distinct words, and pairs of tokens, that a task remembers; beyond, it forgets all and goes on.
REMEMBERED = 400_000
#: Bytes of words scanned together, where there is more than one.
SCANNED = 1 << 20
#: Stands between words in what the automaton reads. It is no Latin-1 character, so no token crosses it.
_BETWEEN = "Ā"


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id. ``left`` and ``right`` are the two tokens whose merge gives a token; both are
    the token itself for single bytes. ``shorter`` is the longest proper prefix, -1 where there is
    none."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    shorter: list[int]
    pattern: str

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Vocabulary:
        """From lines of base64 token and rank. Every byte must be a token, and merging the bytes of
        any other token by the lower ranks must end in two tokens, as it does in every vocabulary
        that was learnt by merging; else two ways of merging could disagree."""
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            tokens[i] = token
        if not all(bytes([b]) in ids for b in range(256)):
            raise ValueError("every single byte must be a token")
        left, right, merges = list(range(len(tokens))), list(range(len(tokens))), {}
        for i, token in enumerate(tokens):
            for cut in range(len(token) - 1, 0, -1):
                a, b = ids.get(token[:cut], i), ids.get(token[cut:], i)
                if a < i and b < i and compatible(a, b, merges, left, right):
                    left[i], right[i] = a, b
                    merges[a, b] = i
                    break
            else:
                if len(token) > 1:
                    raise ValueError(f"no merge of lower ranks gives token {i}")
        shorter = [next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1) for t in tokens]
        return cls(tokens, left, right, shorter, pattern)


def compatible(a: int, b: int, merges: dict[tuple[int, int], int], left: list[int], right: list[int]) -> bool:
    """Whether merging the bytes of tokens ``a`` and ``b`` together gives just these two.

    Undo the later merge of the two sides step by step. At every step the parts that touch at the
    border could have been merged instead; if that merge comes before the one undone last, it
    would have been done and the border would be gone.
    """
    before = len(left)
    while True:
        if merges.get((a, b), before) < before:
            return False
        if right[a] == a and left[b] == b:
            return True
        if left[b] == b or a > b and right[a] != a:
            before, a = a, right[a]
        else:
            # Of equal merges the left one is done first, so the border's own merge wins a tie.
            before, b = b + 1, left[b]


class Coder:
    """Encoder and decoder of one task; remembers words and pairs of tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick
        import regex

        v = vocabulary
        self.tokens, self.left, self.right, self.shorter = v.tokens, v.left, v.right, v.shorter
        self.size = [len(t) for t in v.tokens] + [1]
        self.whole = {t: i for i, t in enumerate(v.tokens) if t}
        self.merges = {(a, b): i for i, (a, b) in enumerate(zip(v.left, v.right)) if a != i}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.add_word(_BETWEEN, len(v.tokens))
        self.automaton.make_automaton()
        self.split = regex.compile(v.pattern)
        self.words: dict[str, tuple[int, ...]] = {}
        self.suits: dict[tuple[int, int], bool] = {}

    def longest(self, text: str) -> list[int]:
        """Longest token from every place. Matches come by their ends, so the last one written
        at a place is the longest that begins there."""
        out, size = [0] * len(text), self.size
        for end, i in self.automaton.iter(text):
            out[end + 1 - size[i]] = i
        return out

    def suit(self, a: int, b: int) -> bool:
        known = self.suits.get((a, b))
        if known is None:
            if len(self.suits) > REMEMBERED:
                self.suits.clear()
            known = self.suits[a, b] = compatible(a, b, self.merges, self.left, self.right)
        return known

    def laid(self, longest: list[int]) -> list[int]:
        """Ids of one word, from the longest token at each of its places."""
        size, shorter, suits, end = self.size, self.shorter, self.suits, len(longest)
        dead, out, at = bytearray(end + 1), [], 0
        token = longest[0]
        while at < end:
            last = out[-1] if out else -1
            while token >= 0:
                to = at + size[token]
                if not dead[to]:
                    ok = True if last < 0 else suits.get((last, token))
                    if ok is None:
                        ok = self.suit(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                if at < end:
                    token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def learn(self, words: Iterable[str]) -> None:
        todo: list[tuple[str, bytes]] = []
        held = 0
        for w in words:
            b = w.encode()
            known = self.whole.get(b)
            if known is not None:
                self.words[w] = (known,)
                continue
            todo.append((w, b))
            held += len(b)
            if held > SCANNED:
                self.scan(todo)
                todo, held = [], 0
        self.scan(todo)

    def scan(self, todo: list[tuple[str, bytes]]) -> None:
        """Words whose longest matches, one behind the other, all suit each other are done; only the
        others are laid place by place."""
        between, size, suits, words = len(self.tokens), self.size, self.suits, self.words
        hard, ids, covered, fine, last = [], [], 0, True, -1
        rest = iter(todo)
        for _, i in self.automaton.iter_long("".join(b.decode("latin-1") + _BETWEEN for _, b in todo)):
            if i == between:
                w, b = next(rest)
                if fine and covered == len(b):
                    words[w] = tuple(ids)
                else:
                    hard.append((w, b))
                ids, covered, fine, last = [], 0, True, -1
                continue
            if fine and last >= 0:
                known = suits.get((last, i))
                fine = self.suit(last, i) if known is None else known
            ids.append(i)
            covered += size[i]
            last = i
        longest, at = self.longest(_BETWEEN.join(b.decode("latin-1") for _, b in hard)), 0
        for w, b in hard:
            words[w] = tuple(self.laid(longest[at : at + len(b)]))
            at += len(b) + 1

    def encode_batch(self, batch: list[str]) -> list[list[int]]:
        if len(self.words) > REMEMBERED:
            self.words = {}
        split = [self.split.findall(t) for t in batch]
        self.learn(set(chain.from_iterable(split)).difference(self.words))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (array<int>) of every text; edges as in ``coded``."""
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shared = shipped(rows.sparkSession, vocabulary)

    def run(batches):
        coder = Coder(unpacked(shared))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield carried(part, "doc_id", ids=pa.array(coder.encode_batch(part.column("text").to_pylist()), pa.list_(pa.int32())))

    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and bytes of every list of ids (null: empty). Bytes, because any list of ids may be
    decoded, also one that breaks a character."""
    shared = shipped(encoded.sparkSession, vocabulary)

    def run(batches):
        coder = Coder(unpacked(shared))
        for b in batches:
            yield carried(b, "doc_id", bytes=pa.array([coder.decode(x.as_py() or ()) for x in b.column("ids")], pa.binary()))

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id bigint, bytes binary")


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256 (ids joined by one space),
    decoded_sha256.

    Every match of the pattern is encoded by itself, nothing is shuffled. Null and empty texts have
    no tokens and the hashes of the empty string; a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives none; other columns are ignored. The vocabulary is of fixed
    size and broadcast; its merges are worked out once, on the driver.
    """
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shared = shipped(rows.sparkSession, vocabulary)

    def run(batches):
        coder, sha = Coder(unpacked(shared)), hashlib.sha256
        digits = [str(i) for i in range(len(coder.tokens))].__getitem__
        for b in batches:
            out, values = [], b.column("text").to_pylist()
            for i in range(0, len(values), 256):
                for ids in coder.encode_batch(values[i : i + 256]):
                    out.append((len(ids), sha(" ".join(map(digits, ids)).encode()).hexdigest(), sha(coder.decode(ids)).hexdigest()))
            n, ids, decoded = zip(*out) if out else ((), (), ())
            yield carried(
                b, "doc_id", n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()),
                decoded_sha256=pa.array(decoded, pa.string()),
            )

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

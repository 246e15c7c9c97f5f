"""Cross-tokenizer alignment by lockstep vectorised merging.

Both tokenizers cut the same bytes, so their tokens are two sorted lists of end offsets, and the
links are what a merge of the two lists meets. One NumPy state vector holds an A pointer and a B
pointer for every lane of a batch. Each step links the two tokens that every lane points at,
advances the pointer whose token ends first, or both where both end together, which cuts the bytes
there, and now and then drops the lanes that are done. A lane is a document or a run of
``LANE`` A tokens of a long one: where it begins, its B pointer is found by binary search, so a text
of any length takes as many steps as a short one.

How many documents hold a pair of ids linked is counted over the whole corpus. A document's pairs
are written once, distinct and with their multiplicity; the counts come back in blocks of whole
A ids of at most ``BLOCK`` pairs, one broadcast after the other, so nothing that is broadcast grows
with the corpus and no link is ever shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monofila.llm.bpe import PATTERN, byte_symbols
from monofila.llm.common import carried, scratch, texts

#: A tokens of a lane, bytes of text aligned together (a longer one alone), pairs of one broadcast block.
LANE, TOGETHER, BLOCK = 256, 1_000_000, 4_000_000
#: Pairs a task counts before it hands them on.
COUNTED = 2_000_000


@dataclass(frozen=True)
class Alignment:
    """Tokens of a batch of documents, end to end. ``a_of`` and ``b_of`` give each document's first
    token (and one entry more); ``a`` and ``b`` are the links' tokens, in no order; a cut lies
    behind A token ``cut_a`` - 1 and B token ``cut_b`` - 1."""

    a_of: np.ndarray
    b_of: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def align(a_sizes: list[np.ndarray], b_sizes: list[np.ndarray], lane: int = LANE) -> Alignment:
    """Links and cuts of documents given as byte sizes of their tokens. Both sides of a document
    must have equal totals, and no token may be empty."""
    a_of = np.cumsum([0, *map(len, a_sizes)])
    b_of = np.cumsum([0, *map(len, b_sizes)])
    ends_a = np.cumsum(np.concatenate([*a_sizes, np.zeros(0, np.int64)]), dtype=np.int64)
    ends_b = np.cumsum(np.concatenate([*b_sizes, np.zeros(0, np.int64)]), dtype=np.int64)
    count = np.diff(a_of)
    lanes = -(-count // lane)
    begin = np.repeat(a_of[:-1], lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(begin + lane, np.repeat(a_of[1:], lanes))
    # The B token that holds the lane's first byte.
    i, j = begin, np.searchsorted(ends_b, np.where(begin > 0, ends_a[begin - 1], 0) if len(begin) else begin, side="right")
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(i):
        link_a.append(i)
        link_b.append(j)
        at_a, at_b = ends_a[i], ends_b[j]
        both = at_a == at_b
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
        if both.any():
            cut_a.append(i[both])
            cut_b.append(j[both])
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    none = [np.zeros(0, np.int64)]
    return Alignment(
        a_of, b_of, np.concatenate(link_a or none), np.concatenate(link_b or none),
        np.sort(np.concatenate(cut_a or none)), np.sort(np.concatenate(cut_b or none)),
    )


def laid_out(found: Alignment, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sides group by group, A before B: (id, what follows it), where 0 stands for
    a comma, 1 for the bar between the sides and 2 for the end of the group."""
    groups_a, groups_b = np.diff(found.cut_a, prepend=0), np.diff(found.cut_b, prepend=0)
    ids, follows = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int8)
    place_a = np.arange(len(ids_a)) + np.repeat(found.cut_b - groups_b, groups_a)
    place_b = np.arange(len(ids_b)) + np.repeat(found.cut_a, groups_b)
    ids[place_a], ids[place_b] = ids_a, ids_b
    follows[place_a[found.cut_a - 1]], follows[place_b[found.cut_b - 1]] = 1, 2
    return ids, follows


class Sides:
    """Both tokenizers of one task: ids of a text, and the bytes that each id stands for."""

    def __init__(self, models: tuple[bytes, bytes]) -> None:
        import sentencepiece

        definition, model = models
        self.encode_a, self.bytes_a = byte_level(definition)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_b = [piece_bytes(self.pieces.id_to_piece(i), self.pieces.is_byte(i)) for i in range(self.pieces.get_piece_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where they do not give back the bytes of the text."""
        if text:
            whole = (" " + text).encode()
            a, b = self.encode_a(" " + text), self.pieces.encode(text)
            if all(b"".join(map(of.__getitem__, ids)) == whole for of, ids in ((self.bytes_a, a), (self.bytes_b, b))):
                return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


def byte_level(definition: bytes):
    """(encoder, bytes per id) of a byte-level BPE file, special strings being plain text.

    Where ids ascend with the merges, and only there, they are ranks, and the faster library for
    ranks gives the same ids.
    """
    file, symbols = json.loads(definition), byte_symbols()
    special = {t["content"] for t in file.get("added_tokens") or []}
    vocab = {token: i for token, i in file["model"]["vocab"].items() if token not in special}
    of = [b""] * (max([*vocab.values(), *(t["id"] for t in file.get("added_tokens") or [])]) + 1)
    for token, i in vocab.items():
        of[i] = bytes(symbols[c] for c in token)
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
    plain = file.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and not file.get("normalizer") and merged == sorted(merged) and len(merged) + 256 == len(vocab):
        import tiktoken

        ranks = {of[i]: i for i in vocab.values()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, of
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, of


def gathered(values: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of at most TOGETHER characters, a longer text alone."""
    begin = held = 0
    for i, v in enumerate(values):
        if held and held + len(v) > TOGETHER:
            yield begin, i
            begin, held = i, 0
        held += len(v)
    if begin < len(values):
        yield begin, len(values)


def links(docs: DataFrame, definition: bytes, model: bytes) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs
    as ``pairs`` (A id * B's vocabulary size + B id, ascending) with ``times``, how often each occurs.

    A text that is null or empty, or whose bytes one side does not give back, has no tokens.
    """
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shared = rows.sparkSession.sparkContext.broadcast((definition, model))

    def run(batches):
        sides = Sides(shared.value)
        ends = b",", b"|", b";"
        told = [str(i).encode() + e for i in range(max(len(sides.sizes_a), len(sides.sizes_b))) for e in ends]
        width = len(sides.sizes_b)
        for batch in batches:
            values = [v or "" for v in batch.column("text").to_pylist()]
            for first, last in gathered(values):
                coded = [sides.encode(v) for v in values[first:last]]
                ids_a, ids_b = (np.concatenate([c[k] for c in coded]) for k in (0, 1))
                found = align([sides.sizes_a[a] for a, _ in coded], [sides.sizes_b[b] for _, b in coded])
                place = np.searchsorted(found.cut_a, found.a_of, side="right")
                ids, follows = laid_out(found, ids_a, ids_b)
                said, at = list(map(told.__getitem__, (ids * 3 + follows).tolist())), found.a_of + found.b_of
                hashes = [hashlib.sha256(b"".join(said[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:])]
                # Links of a document are sorted together by owner and pair.
                owner = np.searchsorted(found.a_of, found.a, side="right") - 1
                span = len(sides.sizes_a) * width
                both, times = np.unique(owner * span + ids_a[found.a] * width + ids_b[found.b], return_counts=True)
                n_links = np.bincount(owner, minlength=last - first)
                starts = np.searchsorted(both, np.arange(last - first + 1) * span).astype(np.int32)
                yield carried(
                    batch.slice(first, last - first), "doc_id",
                    n_a=pa.array(np.diff(found.a_of)), n_b=pa.array(np.diff(found.b_of)),
                    n_groups=pa.array(np.diff(place).astype(np.int64)), n_links=pa.array(n_links.astype(np.int64)),
                    groups_sha256=pa.array(hashes, pa.string()),
                    pairs=pa.ListArray.from_arrays(pa.array(starts), pa.array(both % span)),
                    times=pa.ListArray.from_arrays(pa.array(starts), pa.array(times.astype(np.int32))),
                )

    return rows.mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    )


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair. Tasks count before anything is sent."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size > COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n.astype(np.int64))})

    return linked.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def blocks(counts: DataFrame, width: int, most: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges [from, to) of A ids with at most ``most`` pairs each, or a single A id. The driver sees
    one number per A id, which the vocabulary bounds."""
    sizes = counts.groupBy(F.floor(F.col("pair") / width).cast("bigint").alias("a")).count().orderBy("a").collect()
    out, first, held = [], 0, 0
    for a, n in sizes:
        if held and held + n > most:
            out.append((first, a))
            first, held = a, 0
        held += n
    return [*out, (first, sizes[-1][0] + 1)] if sizes else []


def scored(rows: DataFrame, counts: DataFrame, width: int, first: int, last: int) -> DataFrame:
    """``rows`` with n_best and count_sum raised by their links whose A id lies in the block."""
    block = counts.filter(F.col("pair").between(first * width, last * width - 1)).orderBy("pair").toArrow()
    pair, n = (block.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    own = np.flatnonzero(np.concatenate(([True], pair[1:] // width != pair[:-1] // width)))
    best = n == np.repeat(np.maximum.reduceat(n, own), np.diff(np.append(own, len(n))))
    shared = rows.sparkSession.sparkContext.broadcast((pair, n, best))

    def run(batches):
        pair, n, best = shared.value
        for b in batches:
            lists = b.column("pairs")
            value, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, value), len(pair) - 1)
            times = np.where(pair[at] == value, times, 0)
            size = lists.value_lengths().to_numpy()
            ends = np.cumsum(size)

            def summed(x: np.ndarray) -> np.ndarray:
                total = np.concatenate(([0], np.cumsum(x)))
                return total[ends] - total[ends - size]

            more = {"n_best": summed(times * best[at]), "count_sum": summed(times * n[at])}
            yield pa.RecordBatch.from_pydict({
                name: pa.array(b.column(name).to_numpy() + more[name]) if name in more else b.column(name) for name in b.schema.names
            })

    return rows.mapInArrow(run, rows.schema)


def aligned(docs: DataFrame, definition: bytes, model: bytes, block: int = BLOCK) -> DataFrame:
    """Per input row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``definition`` is a byte-level BPE file (A, which reads a space and the text), ``model`` a
    sentencepiece file (B, which adds that space). Texts that are null or empty, or whose bytes
    either side does not give back, get zeros and an empty hash. A null doc_id stays null; repeated
    rows give repeated rows, and each counts as a document; an empty table gives no rows; other
    columns are ignored. Both files are of fixed size and broadcast.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    linked = scratch(links(docs, definition, model), "links")
    counts = scratch(pair_counts(linked), "pair-counts")
    rows = linked.withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    ranges = blocks(counts, width, block)
    for n, (first, last) in enumerate(ranges):
        rows = scored(rows, counts, width, first, last)
        if n + 1 < len(ranges):
            rows = scratch(rows, "scored-links")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

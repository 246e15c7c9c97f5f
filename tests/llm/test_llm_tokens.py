"""Byte-level BPE by backtracking, and alignment of two tokenizers."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest

import brute
from monofila.llm import alignment, byte_bpe
from monofila.llm.queries import ranked, vocabulary


def own(rank_of):
    return byte_bpe.Vocabulary.of(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in rank_of.items()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ranks():
    return ranked()


@pytest.fixture(scope="module")
def merging():
    import tiktoken

    lines = map(bytes.split, vocabulary("byte_bpe_50k.tiktoken").splitlines())
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={}
    )


def plain_merges(word, ids):
    """Merge the adjacent pair of the lowest rank, leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not found:
            return [ids[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


# 11 byte-level BPE

def test_ids_equal_the_library(spark, docs, rows, ranks, merging):
    got = byte_bpe.coded(docs, ranks).collect()
    want = {}
    for i, t in rows:
        ids = merging.encode_ordinary(t or "")
        want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    ids = byte_bpe.encode(docs, ranks)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: merging.encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(ids, ranks).collect()} == {i: (t or "").encode() for i, t in rows}


def test_every_kind_of_character(ranks, merging):
    coder = byte_bpe.Coder(ranks)
    points = [*range(0x3100), *range(0x4E00, 0x4F00), *range(0xFE00, 0x10400, 3), *range(0x1F300, 0x1F700), 0x10FFFF]
    texts = [f"a{chr(c)} {chr(c)}b" for c in points if not 0xD800 <= c < 0xE000]
    assert coder.encode_batch(texts) == [merging.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("letters", ["ab", "ehtnoi", "aā", "abcdefghijklmnopqrstuvwxyz", " \n\t"])
def test_random_words(ranks, merging, letters):
    rng, coder = random.Random(letters), byte_bpe.Coder(ranks)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    assert coder.encode_batch(texts) == [merging.encode_ordinary(t) for t in texts]


def test_small_vocabularies_against_plain_merging():
    """Merges learnt from random words over two letters make long dead ends."""
    for seed in range(40):
        rng = random.Random(seed)
        ids, tokens = {bytes([b]): b for b in range(256)}, [bytes([b]) for b in range(256)]
        while len(ids) < 290:
            word = bytes(rng.choice(b"ab") for _ in range(40))
            parts = [tokens[i] for i in plain_merges(word, ids)]
            at = rng.randrange(len(parts) - 1) if len(parts) > 1 else None
            if at is not None:
                ids[parts[at] + parts[at + 1]] = len(tokens)
                tokens.append(parts[at] + parts[at + 1])
        coder = byte_bpe.Coder(own(ids))
        for _ in range(40):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
            assert coder.encode_batch([word]) == [plain_merges(word.encode(), ids)], (seed, word)


def test_long_words_take_linear_time(ranks, merging, monkeypatch):
    rng, coder = random.Random(1), byte_bpe.Coder(ranks)
    long = ["a" * 60_000, "".join(rng.choice("ehtnoi") for _ in range(40_000)), " " * 30_000]
    assert coder.encode_batch(long) == [merging.encode_ordinary(t) for t in long]
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    assert byte_bpe.Coder(ranks).encode_batch(long[:2] + ["forgets all of it and goes on"]) == [
        merging.encode_ordinary(t) for t in long[:2] + ["forgets all of it and goes on"]
    ]


def test_byte_bpe_at_the_edges(odd, nothing, ranks, merging):
    got = byte_bpe.coded(odd, ranks)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r.doc_id, len(merging.encode_ordinary(r.text or ""))) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert byte_bpe.coded(nothing, ranks).collect() == []
    with pytest.raises(ValueError):
        own({b"a": 0})
    with pytest.raises(ValueError):
        own({bytes([b]): b for b in range(256)} | {b"abc": 256})


# 13 alignment

@pytest.fixture(scope="module")
def models():
    return vocabulary(), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain(models):
    """Both sides straight from their libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(models[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=models[1])
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(printable))}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    return (
        lambda t: a.encode(t, add_special_tokens=False).ids, lambda i: bytes(symbols[c] for c in a.id_to_token(i)),
        lambda t: b.encode(t), bytes_b,
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("lane, block, together", [(256, 4_000_000, 1_000_000), (3, 40, 500), (1, 1, 1)])
def test_alignment(docs, rows, models, plain, monkeypatch, lane, block, together):
    small = [(i, t) for i, t in rows if len(t or "") < 3_000]
    monkeypatch.setattr(alignment, "TOGETHER", together)
    monkeypatch.setattr(alignment.align, "__defaults__", (lane,))
    if block < 100:
        monkeypatch.setattr(alignment, "scratch", lambda df, name: df.sparkSession.createDataFrame(df.collect(), df.schema))
        small, block = small[:20], 2_000 if block > 1 else 300
    got = alignment.aligned(docs.filter(docs.doc_id.isin([i for i, _ in small])), *models, block=block)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(brute.alignment(small, *plain))


def test_alignment_of_odd_texts(spark, models, plain):
    texts = [
        "<|endoftext|> <s></s><unk>", "▁a ▁", "tab\tnul\0end", "\r\n \n", "  two  blanks ", "日本語 текст 🎉🏽‍♀️é", "é é ﬁ ½ ①",
        "a", " ", "<0x41> <0xZZ>", "﻿mark​", "x" * 700, "\U000e0041",
    ]
    rows = list(enumerate(texts))
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id bigint, text string"), *models)
    want = brute.alignment(rows, *plain)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)
    # The sign for a blank in the text itself reads as a blank.
    assert {d for d, n_a, *_ in want if n_a == 0} == {1}


def test_alignment_at_the_edges(spark, odd, nothing, models, plain):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = alignment.aligned(odd, *models)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute.alignment(rows, *plain), key=repr)
    assert alignment.aligned(nothing, *models).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, alignment.aligned(empty, *models).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_lanes_agree_with_whole_documents():
    rng = random.Random(3)
    sizes = [[np.array(x, dtype=np.int64) for x in two] for two in zip(*(
        (lambda n: (cuts(rng, n), cuts(rng, n)))(rng.randint(0, 300)) for _ in range(50)
    ))]
    whole, split = alignment.align(*sizes, lane=10**6), alignment.align(*sizes, lane=2)
    assert sorted(zip(whole.a.tolist(), whole.b.tolist())) == sorted(zip(split.a.tolist(), split.b.tolist()))
    assert whole.cut_a.tolist() == split.cut_a.tolist() and whole.cut_b.tolist() == split.cut_b.tolist()


def cuts(rng, n):
    ends = sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 60)))) + [n] if n else []
    return np.diff([0, *ends]).tolist()

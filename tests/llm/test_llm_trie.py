"""Conversation prefix trie against a plain trie of tuples."""

import random

import pytest

import brute
from monofila.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, n int, k1 int, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)


def tree(df):
    return sorted(map(tuple, df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def talks(seed, convs, letters, longest):
    rng = random.Random(seed)
    return [
        (c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", None, "bot"]) if letters > 2 else "u", rng.choice("abcdefgh"[:letters]) * rng.randint(1, 2))
        for c in rng.sample(range(convs * 2), convs) for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize(
    "seed, convs, letters, longest, partitions, segment", [(1, 60, 8, 12, 8, 64), (2, 120, 1, 9, 8, 3), (3, 200, 2, 14, 3, 2), (4, 40, 2, 30, 16, 1), (4, 40, 2, 30, 16, 64)]
)
def test_trie(spark, monkeypatch, seed, convs, letters, longest, partitions, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE", 32)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = talks(seed, convs, letters, longest)
        assert tree(prefix_trie.prefix_trie(frame(spark, rows))) == brute.prefix_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_long_conversation_and_many_copies(spark):
    rows = [(0, t, "user", f"t{t % 7}") for t in range(1_500)] + [(1, t, "user", f"t{t % 7}") for t in range(700)]
    rows += [(c, t, "user", "same" * (t + 1)) for c in range(10, 400) for t in range(3)]
    assert tree(prefix_trie.prefix_trie(frame(spark, rows))) == brute.prefix_trie(rows)


def test_trie_at_the_edges(spark):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 2, None, "x"), (2**60 + 3, 1, "user", ""), (11, 5, "bot", "y" * 5_000)]
    got = prefix_trie.prefix_trie(frame(spark, rows))
    assert tree(got) == brute.prefix_trie(rows)
    assert prefix_trie.prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "lost")])).collect() == []
    # Repeated rows are repeated turns, whatever the order of the rows.
    twice = [(5, 1, "u", "b"), (5, 1, "u", "a"), (5, 1, "u", "b"), (5, 2, "u", "c")]
    assert tree(prefix_trie.prefix_trie(frame(spark, twice))) == tree(prefix_trie.prefix_trie(frame(spark, twice[::-1])))

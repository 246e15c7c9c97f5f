import random

import public_tokenizers
import pytest

NAMES = "doc_id bigint, text string, lang string, source string, n_chars int, n_words int, kept string, key int, d int, size int, h int, shard int, removed int"


@pytest.fixture(scope="session")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@pytest.fixture(scope="session")
def library(definition):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition.decode())


def corpus():
    """Texts with every oddity: nulls, blanks, copies, near copies, shared passages and lines."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, line = prose(70), prose(12)
    texts = [None, "", " \t\n ", "one", "One", "two words", "TWO  WORDS", "a b   \u0085é\x1c", "<|endoftext|> x<|endoftext|>"]
    for _ in range(12):
        base = prose(rng.randint(60, 160)).split(" ")
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [prose(20) + "\n" + passage + "\n" + prose(9) + "\n" + line for _ in range(6)]
    texts += [line[: rng.randrange(20, 40)] + "x" + line[40:] + "\n" + prose(5) for _ in range(6)]
    texts += [texts[12], texts[12].replace(" ", "\n\t"), prose(3_000), "word " * 5_000, "q" * 4_000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names the operators use themselves."""
    wide = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 1, "x", 2, 3, 4, 5, 6, 7) for i, t in rows]
    return spark.createDataFrame(wide, NAMES).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated ids and rows that are alike in everything."""
    long = " ".join(f"w{i}" for i in range(60))
    wide = [(None, long), (None, long), (None, None), (5, long), (5, long), (5, "other text of these rows"), (2**60, long), (7, None)]
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3, 4, 5, 6, 7) for i, t in wide], NAMES)


@pytest.fixture(scope="session")
def labels(spark, rows):
    marks = [(i, 1 if i % 5 else 0, 0) for i, _ in rows] + [(None, 1, 0), (3, None, None), (10**6, 0, 1)]
    return spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")

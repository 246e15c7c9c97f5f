"""Each operator against its plain version, and its defined results at the edges."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from monofila.llm import bpe, common, exact_dedup, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, repeats, sharding, substring_dedup, token_counts


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1 token counts

@pytest.mark.parametrize("chunk, overlap", [(65_536, 1_024), (200, 16), (40, 8)])
def test_token_counts_equal_the_library(docs, rows, definition, library, chunk, overlap):
    got = token_counts.token_counts(docs, definition, chunk, overlap, limit=30)
    count = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in rows}
    want = [(i, len((t or "").encode()), count[i], count[i] > 30) for i, t in rows]
    assert tuples(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_token_counts_at_the_edges(odd, nothing, definition, library):
    got = token_counts.token_counts(odd, definition, chunk=50, overlap=8)
    want = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False))) for r in odd.fillna(-1, "doc_id").collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_counts.token_counts(nothing, definition).collect() == []


def test_chunk_borders_near_a_special_string(spark, definition, library):
    texts = ["x" * k + " y <|endoftext|>  it's 'rest 'll <|endoftext|>z" * 6 for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = token_counts.token_counts(df, definition, chunk=37, overlap=32)
    assert tuples(got, "doc_id", "n_tokens") == sorted(((i, len(library.encode(t, add_special_tokens=False))) for i, t in enumerate(texts)), key=repr)


# 2 substring dedup

@pytest.mark.parametrize("crowded", [1_000, 1])
def test_substring_dedup(docs, rows, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    got = substring_dedup.substring_dedup(docs)
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(rows), key=repr)


def test_substring_dedup_at_the_edges(odd, nothing):
    got = substring_dedup.substring_dedup(odd)
    want = brute.substring_dedup([(r.doc_id, r.text) for r in odd.collect()])
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(nothing).collect() == []


# 3 sharding

@pytest.mark.parametrize("shards", [1, 5, 24])
def test_byte_shards(docs, rows, shards):
    got = sharding.byte_shards(docs, shards).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by = defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(shards))


def test_byte_shards_are_even_though_one_text_fills_most(spark):
    rows = [(i, "the same text again" if i % 3 else f"text {i} " * (1 + i % 5)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    size = Counter()
    for r in sharding.byte_shards(df, 8).collect():
        size[r.shard] += r["size"]
    even = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(x - even) < 200 + 0.01 * even for x in size.values())


def test_byte_shards_at_the_edges(odd, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 2)
    got = sharding.byte_shards(odd, 3).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == odd.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.byte_shards(nothing).collect() == []


# 4 near dedup

@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_components(docs, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs, k, percent).collect()}
    assert got == brute.near_components(rows, k, percent)


def test_near_components_at_the_edges(odd, nothing):
    got = near_dedup.near_components(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.collect() if r.n_shingles == 58} == {5}
    assert near_dedup.near_components(nothing).collect() == []


def test_texts_that_share_a_doc_id_keep_their_links(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, "quite another text here")]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_a_large_group_of_near_copies(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    copies = []
    for i in range(250):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        copies.append((i, " ".join(copy)))
    rng.shuffle(copies)
    got = near_dedup.near_components(spark.createDataFrame(copies, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute.near_components(copies)


def test_chains_of_links_are_followed(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)]
    df = spark.createDataFrame(chain, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(df).collect()}
    assert got == brute.near_components(chain) and {v[1] for v in got.values()} == {0}


# 5 BPE

def test_bpe_round_trip(docs, rows, definition, library):
    got = bpe.round_trip(docs, definition)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert tuples(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_encode_and_decode(docs, odd, nothing, rows, definition, library):
    encoded = bpe.encode(docs, definition)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, definition).collect()} == {i: t or "" for i, t in rows}
    assert bpe.round_trip(odd, definition).count() == odd.count()
    assert bpe.round_trip(nothing, definition).collect() == []
    codec = bpe.Codec(definition)
    for ids in ([], [50256], [0, 255, 128, 240], list(range(180, 260))):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_scanning_and_heap_agree(definition, library):
    codec = bpe.Codec(definition)
    for word in ("a" * 300, "abc" * 40, "ééà" * 30, " hello", "x", "ing" * 22):
        ids = tuple(library.encode(word, add_special_tokens=False).ids)
        assert codec.heap(word.encode()) == codec.scan([word.encode()])[0] == ids


# 6 mixing

def test_pfair_deviation_is_below_one_block():
    for weights, period in (([1], 8), ([5, 1, 1], 64), ([0.5, 0.3, 0.15, 0.05], 100), ([1 / 3] * 3 + [1e-6], 1_024), (list(range(1, 30)), 128)):
        shares = mixing.units(weights, period)
        slots = mixing.period_slots(shares)
        assert sorted(sum(slots, [])) == list(range(sum(shares)))
        for share, own in zip(shares, slots):
            for t in range(period):
                assert abs(sum(s <= t for s in own) - share * (t + 1) / period) < 1


def test_mix_lays_out_every_document(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 5)
    got = mixing.placed(docs, block=500, period=64).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    taken = defaultdict(set)
    for r in got:
        assert r.release <= r.slot < r.deadline
        taken[r.slot].add(r.source)
    assert all(len(v) == 1 for v in taken.values())
    end = min((r.slot for r in got if not r.in_mix), default=None)
    assert end is None or all(r.slot < end for r in got if r.in_mix)
    assert any(r.in_mix for r in got)


def test_mix_follows_given_weights(spark):
    rows = [(i, "x" * 100, "abc"[min(i % 6, 2)]) for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [r for r in mixing.placed(df, {"a": 1, "b": 3}, block=1_000).collect() if r.in_mix]
    n = Counter(r.source for r in got)
    assert set(n) == {"a", "b"} and abs(n["b"] / n["a"] - 3) < 0.1
    assert mixing.mixed_documents(df).columns == df.columns


def test_a_source_that_runs_dry_ends_nothing(spark):
    rows = [(i, "x" * 1_000, f"s{i % 3}") for i in range(3_000)] + [(3_000, "tiny", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.placed(df, block=1_000).collect()
    assert sorted({r.slot for r in got}) == list(range(3_001))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert sum(r.in_mix for r in got) > 2_900
    slots = defaultdict(list)
    for r in got:
        slots[r.source].append(r.slot)
    for s in ("s0", "s1", "s2"):
        assert all(abs(sum(x <= t for x in slots[s]) - (t + 1) / 3) <= 1.01 for t in range(0, 3_000, 100))
    assert mixing.mixed_documents(df).count() == len(rows)


def test_sources_that_are_left_share_what_a_dry_one_had():
    blocks, weights = [10, 100, 7, 1], [8, 3, 2, 1]
    got = list(mixing.schedule(blocks, weights))
    assert Counter(s for s, *_ in got) == dict(enumerate(blocks))
    assert all(release <= t < deadline for t, (_, _, release, deadline) in enumerate(got))
    assert [s for s, *_ in got[-60:]] == [1] * 60


def test_parts_of_a_source_leave_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 10)
    rows = [(i, "x" * 100, "a") for i in range(1_000)] + [(i, None, "a") for i in range(1_000, 1_050)]
    got = mixing.placed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=800).collect()
    assert sorted(r.block * 800 + r.start for r in got if r.size) == list(range(0, 100_000, 100))
    assert max(r.block for r in got) == 124 and all(0 <= r.start <= 800 and r.slot == r.block for r in got)


def test_every_source_has_its_own_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rows = [(i, "x" * 100, f"s{i % 5}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [r for r in mixing.placed(df, {"s0": 1, "s3": 1, "s4": 2}, block=100).collect() if r.in_mix]
    n = Counter(r.source for r in got)
    assert set(n) == {"s0", "s3", "s4"} and n["s4"] == 100 and abs(n["s0"] - 50) <= 1 and abs(n["s3"] - 50) <= 1


def test_mix_at_the_edges(odd, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    assert mixing.mix(odd).count() == odd.count()
    wide = odd.withColumn("source", F.col("doc_id").cast("string"))
    assert mixing.mix(wide).count() == odd.count()
    assert mixing.mix(nothing).collect() == [] and mixing.mixed_documents(nothing).collect() == []


# 7 exact dedup

@pytest.mark.parametrize("cells", [1 << 18, 1 << 30])
def test_exact_dedup(docs, rows, cells):
    got = exact_dedup.exact_dedup(docs, cells)
    assert tuples(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact_dedup(rows), key=repr)


def test_a_full_filter_only_costs_shuffle(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1)
    rows = [(i, f"text {i % 700}") for i in range(1_000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), most_cells=8)
    assert tuples(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact_dedup(rows), key=repr)


def test_exact_dedup_at_the_edges(odd, nothing):
    got = exact_dedup.exact_dedup(odd)
    long = [r for r in got.collect() if r.group_size == 5]
    assert len(long) == 5 and {r.keep_id for r in long} == {5} and sum(r.kept for r in long) == 1
    assert got.count() == odd.count() and exact_dedup.exact_dedup(nothing).collect() == []


# 8 quality rules

def test_rule_counts(docs, rows, labels):
    got = quality_rules.quality_rules(docs, labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = []
    for i, t in rows:
        c = brute.rule_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert tuples(got, "doc_id", *names, "base_failed") == sorted(want, key=repr)
    assert got.filter("base_failed AND kept").count() == 0


def test_forest_isolates_what_is_unlike():
    import numpy as np

    rng = np.random.default_rng(1)
    usual, strange = rng.normal(0, 1, (2_000, 4)), rng.normal(0, 1, (20, 4)) + 9
    forest = quality_rules.Forest.fit(np.vstack([usual, strange]))
    forest.calibrate(forest.score(usual), forest.score(strange))
    assert (forest.score(strange) > forest.threshold).all() and (forest.score(usual) > forest.threshold).mean() <= 0.005


def test_quality_rules_at_the_edges(odd, nothing, labels):
    assert quality_rules.quality_rules(odd, labels).count() == odd.count()
    assert quality_rules.quality_rules(nothing, labels).collect() == []
    alone = quality_rules.quality_rules(odd, labels.limit(0))
    assert alone.filter("kept = base_failed").count() == 0


# 9 line dedup

def test_edit_distance():
    import random

    rng = random.Random(2)
    for _ in range(3_000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 10))) for _ in range(2))
        for most in range(4):
            assert line_dedup.edit_distance_within(a, b, most) == (brute.edit_distance(a, b) <= most)


def test_line_dedup(docs, rows):
    got = {r.doc_id: (r.n_lines, r.n_removed, sorted(r.removed)) for r in line_dedup.line_dedup(docs).collect()}
    want = brute.line_dedup(rows)
    assert got == {i: ((t or "").count("\n") + 1, len(want[i]), want[i]) for i, t in rows}


def test_segments_of_arrow_slices():
    """Hashed as they lie in a batch: slices, characters beyond the first plane, and what one edit may change."""
    lines = ["plain line of some words", "ñandú 日本 and more", "\U0001f600 beyond the first plane \uffff", "plain line of some wordz"]
    whole, cut = line_dedup.Segments(pa.array(lines)), line_dedup.Segments(pa.array(["other", *lines, "last"]).slice(1, 4))
    assert cut.length.tolist() == [len(x) for x in lines]
    for name in ("start", "total", "parity", "sketch"):
        assert getattr(whole, name).tolist() == getattr(cut, name).tolist()
    assert (int(whole.sketch[0]) ^ int(whole.sketch[3])).bit_count() <= 4 and (int(whole.parity[0]) ^ int(whole.parity[3])).bit_count() == 2
    size = np.full(2, 10)
    keys = whole.key(whole.start[[0, 3]], size, np.full(2, 24), 0)
    assert keys[0] == keys[1] != whole.key(whole.start[[1]], size[:1], np.full(1, 24), 0)[0]
    assert len(line_dedup.Segments(pa.array([], pa.string())).sketch) == 0


def test_line_dedup_cuts_lines(docs, rows):
    want = brute.line_dedup(rows)
    out = {}
    for i, t in rows:
        if want[i]:
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
            if not brute.words(t):
                continue
        out[i] = t
    got = line_dedup.without_repeated_lines(docs)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == out


def test_short_lines_go_when_equal(spark):
    rows = [(1, "Les.\n\n \nshort line"), (2, "Les.\n\n \nshort lime\nLes."), (3, None), (4, "Les."), (None, "short line\nx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: sorted(r.removed) for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: [], 2: [0, 4], 3: [], 4: [0], None: [0]}
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df).collect()}
    assert kept == {1: rows[0][1], 2: "\n \nshort lime", 3: None, None: "x"}


def template_lines(size, seed=6):
    """Lines that differ from one text in one or two places, and from each other in up to four."""
    import random

    rng = random.Random(seed)
    base = "this very common line of boilerplate stands on every page of the site, year after year"
    rows = []
    for i in range(size):
        line = list(base)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(line))
            line[at : at + 1] = rng.choice([["#"], ["@", "@"], [], [line[at]]])
        rows.append((i, "".join(line)))
    return rows


@pytest.mark.parametrize("crowd", [2, 16, 10**9])
def test_a_group_of_near_lines(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rows = template_lines(220)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.removed for r in got.collect()} == brute.line_dedup(rows)


def test_pairs_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    pairs = []
    write = line_dedup.scratch

    def counted(df, name):
        out = write(df, name)
        if name.endswith("pairs"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "scratch", counted)
    for size in (500, 2_000):
        rows = template_lines(size)
        line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert sum(pairs[2:]) < 8 * sum(pairs[:2]) and sum(pairs[2:]) < 20 * 2_000


def test_near_lines_share_a_coarse_key(spark):
    """Lines of all lengths around the limits, with as many edits as they may differ by, anywhere."""
    import random

    rng = random.Random(8)
    pairs = []
    for length in [*range(20, 75), 99, 100, 101, 250]:
        for most in range(3):
            for _ in range(12):
                a = [rng.choice("ab é\U0001f600" if rng.random() < 0.5 else "abcdefgh") for _ in range(length)]
                b = list(a)
                for _ in range(most):
                    at = rng.choice([0, len(b) - 1, rng.randrange(len(b)), len(b) // 3, len(b) - len(b) // 3])
                    b[at : at + 1] = rng.choice([["#"], ["@", b[at]], [b[at], "@"], []])
                a, b = "".join(a), "".join(b)
                if min(len(a), len(b)) >= 20 and brute.edit_distance(a, b) <= min(2, min(len(a), len(b)) // 20):
                    pairs.append((a, b))
    keys = [line_dedup.coarse_keys(F.col(c)) for c in "ab"]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert len(pairs) > 1_500 and df.filter(~F.arrays_overlap(*keys)).collect() == []
    assert df.filter(F.exists(keys[0], lambda x: x.isNull()) | (F.size(keys[0]) > 8)).count() == 0


def test_lines_unlike_all_others_are_not_indexed(spark, monkeypatch):
    written = {}
    write = line_dedup.scratch

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "scratch", counted)
    near = template_lines(40)
    rows = near + [(100 + i, f"{i * 7919 % 100_003:06d} is a line {i * 104_729 % 99_991:06d} like no other one {i * 31_337 % 99_989:06d}") for i in range(2_000)]
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.line_dedup(near) | {i: [] for i, _ in rows[40:]}
    assert written["lines"] > 2_000 and written["line-index"] <= 3 * 60


def test_line_dedup_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "filter_cells", lambda hashes: 8 * 32_768)
    rows = template_lines(60) + [(100 + i, f"{'line %06d of some other document ' % (i * 7919)}{i}") for i in range(3_000)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute.line_dedup(rows[:60])
    assert {r.doc_id: r.removed for r in got.collect() if r.doc_id < 60} == want


def test_line_dedup_at_the_edges(odd, nothing):
    got = line_dedup.line_dedup(odd)
    assert got.count() == odd.count()
    assert [r.n_removed for r in got.collect() if r.doc_id == 2**60] == [1]
    assert line_dedup.line_dedup(nothing).collect() == []


# 10 quality classifier

def test_weak_labels_find_accuracies():
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.random(5_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.8])
    right = rng.random((5_000, 4)) < accuracy
    said = np.where(right, good[:, None], ~good[:, None]).astype(np.int64)
    patterns, at, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    model = quality_classifier.WeakLabels.fit(patterns, counts.astype(float))
    belief = model.posterior(patterns)[at.ravel()] > 0.5
    assert (belief == good).mean() > 0.8
    assert model.accuracy().shape == (2, 4)


def test_quality_classifier_on_held_out_documents(spark):
    """Trained on weak labels only; the labels of the fixture are never seen."""
    import random

    rng = random.Random(5)
    common = ["the", "of", "and", "river", "stone", "walked", "house", "under", "evening", "light", "slowly", "table"]
    rows = []
    for i in range(600):
        words = [rng.choice(common) + rng.choice(["", "s", ",", "."]) for _ in range(rng.randint(60, 120))]
        if i % 4 == 0:
            words = [[w + "###" for w in words], [w.upper() + "!!" for w in words], [words[0]] * 80][i // 4 % 3]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = quality_classifier.quality_classifier(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), trained=200)
    right = sum(r.kept == (r.doc_id % 4 != 0) for r in got.collect())
    assert right >= 590


def test_every_vote_pattern_is_trained_on():
    assert quality_classifier.dealt(np.array([1, 3, 50_000, 20]), 40).tolist() == [1, 3, 18, 18]
    assert quality_classifier.dealt(np.array([5, 5, 5]), 2).tolist() == [1, 1, 1]
    assert quality_classifier.dealt(np.array([], dtype=np.int64), 2).tolist() == []


@pytest.mark.parametrize("with_ids", [True, False])
def test_rare_junk_is_rejected(spark, with_ids):
    """One document in 20,000 shouts; it and its like outside the sample must go."""
    rng = np.random.default_rng(3)
    plain = ["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (3_000, 5))]
    texts = [" ".join(rng.choice(plain, 40)) + f" page {i}" for i in range(19_999)]
    shout = "BUY THIS NOW!!! " * 15
    texts += [shout] + ["#### $$$$ **** #### $$$$ **** " + texts[i] for i in range(600)]
    docs = spark.createDataFrame([(i if with_ids else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    # The query's result carries no text; a document is told by its score alone where it has no id.
    rejected = quality_classifier.quality_classifier(docs, labels).filter("NOT kept")
    assert 601 <= rejected.count() <= 640
    if with_ids:
        assert rejected.filter("doc_id = 19999").count() == 1


def test_quality_classifier_at_the_edges(odd, nothing, docs, labels):
    got = quality_classifier.quality_classifier(odd, labels)
    assert got.count() == odd.count() and not [r for r in got.filter("doc_id = 7").collect() if r.kept]
    assert quality_classifier.quality_classifier(nothing, labels).collect() == []
    assert quality_classifier.quality_classifier(docs, labels.limit(0)).count() == docs.count()


def test_nth_lowest_counts_every_row(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(500), np.full(300, 0.25), 1e-9 * rng.random(200)])
    rows = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(4)
    for n in (0, 150, 420, 999):
        assert common.nth_lowest(rows, "score", n) == np.sort(values)[n]


def test_thresholds_come_from_every_labelled_row(spark):
    """More labelled rows than were once read; one of them alone lowers the threshold."""
    n = 30_000
    scored = spark.range(n).select(F.col("id").alias("doc_id"), (0.4 + F.col("id") / 1e6).alias("score"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = quality_classifier.calibrated(quality_classifier.Scorer(np.zeros(1), 0.0), scored, labels)
    assert got.threshold == np.quantile(0.4 + np.arange(n) / 1e6, 1 - quality_classifier.KEEP, method="lower")


def test_every_labelled_row_may_grow_a_tree(spark):
    counts = {c: F.lit(100) for c in quality_rules.COUNTS} | {"word_chars": F.col("id") + 100}
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), *[x.cast("bigint").alias(c) for c, x in counts.items()], F.lit(0).alias("copy"))
    got = quality_rules.drawn(rows, 3_000)
    assert {len(x) for x in got} == {quality_rules.SAMPLE} and len(got) == quality_rules.TREES
    assert len({x for m in got for x in m[:, 0]}) > 2_900
    assert all(len(set(m[:, 0])) == quality_rules.SAMPLE for m in got)

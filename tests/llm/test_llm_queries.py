"""Registered queries on the smallest data folder, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as registry
import brute
import corpus_pipeline
from compare import connect, difference
from monofila.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in registry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in registry.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert difference(registry.queries()[name](spark, FOLDER), connect(FOLDER), registry.oracle_sql()[name]) is None


def test_substring_query(spark, texts):
    got = registry.queries()["op2_substring_dedup"](spark, FOLDER).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(texts))


def test_near_query(spark, texts):
    got = registry.queries()["op4_minhash_hamming"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_components(texts)


def test_line_query(spark, texts):
    got = registry.queries()["op9_line_dedup"](spark, FOLDER).collect()
    want = brute.line_dedup(texts)
    assert {r.doc_id: sorted(r.removed) for r in got} == want


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_byte_shards", "op5_bpe_round_trip", "op6_pfair_mix", "op8_quality_rules", "op10_quality_classifier", "op11_byte_bpe", "op13_alignment"])
def test_one_row_per_document(spark, texts, name):
    got = registry.queries()[name](spark, FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in texts)


def test_trie_query(spark):
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    got = registry.queries()["op12_prefix_trie"](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == brute.prefix_trie(rows)


def test_pipeline_stages(spark, tmp_path, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, FOLDER).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        here = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        ids = {r.doc_id for r in after.collect()}
        assert ids <= set(here) and len(ids) == after.count()
        if name == "line_dedup":
            want = brute.line_dedup(list(here.items()))
            for r in after.collect():
                lines = here[r.doc_id].split("\n")
                assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in want[r.doc_id]) and r.n_chars == len(r.text)
        if name == "near_dedup":
            want = brute.near_components(list(here.items()), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
            assert ids == {i for i, (_, _, kept) in want.items() if kept}
        if name == "bpe":
            for r in after.collect():
                assert r.ids == library.encode(here[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
                assert r.decoded_sha256 == brute.sha(here[r.doc_id])
        else:
            assert after.columns == columns
        before = after


def test_pipeline_keeps_one_row_of_each_group(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, near), (7, near), (7, near), (5, other), (5, text + " y"), (None, " ".join(f"u{i}" for i in range(60)))] + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(5, other), (5, text + " y"), rows[6], (None, None), (None, None)], key=str)

    def verdicts(docs, labels, keep=()):
        return docs.withColumn("kept", docs["text"].startswith("w")).select("doc_id", *keep, "kept")

    monkeypatch.setattr(corpus_pipeline, "quality_classifier", verdicts)
    got = corpus_pipeline.good_documents(spark, docs, FOLDER).collect()
    assert len(got) == 5 and all(r.text.startswith("w") for r in got)


def test_order_of_the_mix_reaches_the_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    corpus_pipeline.mixture(spark, docs, FOLDER).write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.token_ids(spark, spark.read.parquet(f"{tmp_path}/mixed"), FOLDER).orderBy("mix_file", "mix_row")
    place = {r.doc_id: (r.slot, r.start) for r in registry.queries()["op6_pfair_mix"](spark, FOLDER).collect()}
    assert [r.doc_id for r in got.collect()] == sorted(place, key=lambda i: (*place[i], i))

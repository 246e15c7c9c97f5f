"""The operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from monofila.llm.alignment import aligned
from monofila.llm.bpe import round_trip
from monofila.llm.byte_bpe import Vocabulary, coded
from monofila.llm.common import table
from monofila.llm.exact_dedup import exact_dedup
from monofila.llm.line_dedup import line_dedup
from monofila.llm.mixing import mix
from monofila.llm.near_dedup import near_components
from monofila.llm.prefix_trie import prefix_trie
from monofila.llm.quality_classifier import quality_classifier
from monofila.llm.quality_rules import quality_rules
from monofila.llm.sharding import byte_shards
from monofila.llm.substring_dedup import substring_dedup
from monofila.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def ranked() -> Vocabulary:
    import public_tokenizers

    return Vocabulary.of(vocabulary(RANKS), public_tokenizers.PATTERN)


def queries() -> dict[str, Query]:
    def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: operator(table(spark, folder, "documents"))

    def with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: operator(table(spark, folder, "documents"), table(spark, folder, "labels"))

    def pipeline(spark: SparkSession, folder: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, folder)

    return {
        "pipeline": pipeline,
        "op1_token_counts": on_documents(lambda docs: token_counts(docs, vocabulary())),
        "op2_substring_dedup": on_documents(substring_dedup),
        "op3_byte_shards": on_documents(byte_shards),
        "op4_minhash_hamming": on_documents(near_components),
        "op5_bpe_round_trip": on_documents(lambda docs: round_trip(docs, vocabulary())),
        "op6_pfair_mix": on_documents(mix),
        "op7_exact_dedup": on_documents(exact_dedup),
        "op8_quality_rules": with_labels(quality_rules),
        "op9_line_dedup": on_documents(line_dedup),
        "op10_quality_classifier": with_labels(quality_classifier),
        "op11_byte_bpe": on_documents(lambda docs: coded(docs, ranked())),
        "op12_prefix_trie": lambda spark, folder: prefix_trie(table(spark, folder, "conversations")),
        "op13_alignment": on_documents(lambda docs: aligned(docs, vocabulary(), vocabulary(PIECES))),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_DEDUP, "op4_minhash_hamming": NEAR_COMPONENTS, "op7_exact_dedup": EXACT_DEDUP}


EXACT_DEDUP = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
seen AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN seen USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

NEAR_COMPONENTS = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM d JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""

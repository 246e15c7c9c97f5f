"""From raw documents to token ids: five stages, each written before the next one reads it.

quality classifier   documents that it rejects go
line dedup           lines that occur earlier, or nearly so, go; emptied documents go
near dedup           one document of each near-duplicate group stays
mixing               all documents, in files and rows in the order of the mix
BPE                  ids of every text, and proof that they decode to it, with its place in that order
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monofila.llm.bpe import round_trip
from monofila.llm.common import scratch, table
from monofila.llm.line_dedup import without_repeated_lines
from monofila.llm.mixing import mixed_documents
from monofila.llm.near_dedup import near_components
from monofila.llm.quality_classifier import quality_classifier
from monofila.llm.queries import vocabulary

#: Near duplicates share this percentage of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of doc_id and text, which rows without an id or with a shared one have too."""
    return docs.withColumn("__id", F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    verdict = quality_classifier(rows, table(spark, sf_dir, "labels"), keep=("__id",))
    return rows.join(verdict.filter("kept").select("__id").distinct(), "__id", "left_semi").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id (null last), then text hash. Texts without
    words are in no group and stay."""
    rows = keyed(docs)
    found = near_components(rows.select(F.col("__id").alias("doc_id"), "text"), SHINGLE, PERCENT)
    groups = found.groupBy(F.col("doc_id").alias("__id")).agg(
        F.first("component_id").alias("group"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")
    )
    ids = rows.groupBy("__id").agg(F.min(F.col("doc_id").cast("bigint")).alias("d"))
    place = F.struct(F.col("d").isNull().alias("last"), "d", "__id", ((F.col("copies") > 1) & (F.col("n_shingles") > 0)).alias("repeated"))
    first = groups.join(ids, "__id").groupBy("group").agg(F.min(place).alias("first"))
    stay = scratch(first.select("first.__id", "first.repeated"), "survivors")
    alone = rows.join(stay.filter("NOT repeated"), "__id", "left_semi")
    again = rows.join(stay.filter("repeated"), "__id", "left_semi").dropDuplicates(["__id"])
    return alone.unionByName(again).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with ``mix_file`` and ``mix_row``: sorted by them, documents stand in the order in which
    ``mixture`` was written. A scan hands files out by size, so the order must be in the rows."""
    name = F.col("_metadata.file_name")
    number = [F.regexp_extract(name, pattern, 1).try_cast("bigint") for pattern in (r"^part-(\d+)-", r"-c(\d+)\.")]
    place = F.coalesce(number[0], F.lit(0)) * 1_000_000 + F.coalesce(number[1], F.lit(0))
    rows = docs.select("*", place.alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    return round_trip(rows, vocabulary(), with_ids=True, keep=("mix_file", "mix_row"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("mixing", mixture),
    ("bpe", token_ids),
]

#: EM, automata and schedules have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

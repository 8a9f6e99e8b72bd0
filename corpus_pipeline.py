"""A training-data pipeline over the table of documents.

Each stage reads what its predecessor kept.  All but the last return the columns of documents;
columns beyond them are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope import scratch
from veriscope.llm.bpe import bpe
from veriscope.llm.mixing import mix
from veriscope.llm.quality import quality
from veriscope.llm.secrets import redacted, secrets
from veriscope.llm.simhash import near_duplicates
from veriscope.llm.texts import small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality(docs.select(COLUMNS), keep=COLUMNS).filter("kept").select(COLUMNS)


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8.

    Rows that repeat a doc_id are one document, of which the least row stays; it goes only if none of them is
    the first of a group.  Rows without a doc_id stay.
    """
    own = docs.select(COLUMNS)
    is_first = F.bool_or(F.col("doc_id") == F.col("component_id")).alias("is_first")
    gone = near_duplicates(own).filter("doc_id is not null").groupBy("doc_id").agg(is_first).filter("not is_first").select("doc_id")
    gone = small(scratch.table(gone, "gone"))
    again = own.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id")
    again = small(scratch.table(again, "again"))
    left = own.join(gone, "doc_id", "left_anti")
    least = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return left.join(again, "doc_id", "left_anti").select(COLUMNS).unionByName(least.select(COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret found, and every linked part of one, blanked out in place."""
    found = secrets(docs.select(COLUMNS), keep=COLUMNS)
    return found.withColumn("text", redacted(F.col("text"), F.col("base"), F.col("added"))).select(COLUMNS)


def interleaved(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order in which the schedule of sources lets them run."""
    placed = mix(docs.select(COLUMNS), keep=COLUMNS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place").select(COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    coded = bpe(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", rules),
    ("simhash_near_dedup", one_of_copies),
    ("secret_scans", without_secrets),
    ("mixing_sources", interleaved),
    ("byte_level_bpe", tokenized),
]

#: SimHash components, estimation and ranked merges have no SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote is deleted once the next one has read it."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.mark()
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = scratch.table(docs, name)
            scratch.release(keep=docs, since=start)
    return docs

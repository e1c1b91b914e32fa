"""The corpus pipeline: five stages from raw documents to training ids.

Each stage works on all that its predecessor kept; what a stage returns is
written as Parquet and read again, so a later failure repeats one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketwise.llm.common import discard, materialize, temporary
from bucketwise.llm.language_id import UNDETERMINED, train, with_language
from bucketwise.llm.mixing import emit_copies, mix_sources
from bucketwise.llm.near_dedup import deduplicate
from bucketwise.llm.pii import replace_pii, session_key
from bucketwise.llm.sentence_pieces import with_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no language that was learned."""
    judged = with_language(docs.select(*COLUMNS), train(docs))
    return judged.where((F.col("lid_lang") != UNDETERMINED) & F.col("lid_known")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays."""
    return deduplicate(docs).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows a text that changed."""
    changed = replace_pii(docs, session_key(spark))
    return changed.withColumn(
        "n_chars", F.when(F.col("pii_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from none to three times."""
    return emit_copies(mix_sources(docs)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, and whether they decode to its text."""
    return with_pieces(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id",
        "lang",
        "source",
        F.col("sp_ids").alias("ids"),
        F.size("sp_ids").cast("long").alias("n_ids"),
        (F.col("sp_decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("mix_sources", mix_to_weights),
    ("sentence_pieces", encode_pieces),
]

#: Fingerprints, classifiers and pieces are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary() as scratch:  # what a stage wrote for itself goes with it
            after = scratch.keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

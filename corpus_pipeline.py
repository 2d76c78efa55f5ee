"""A training corpus from ``documents``: language, repeated lines, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.llm import jaccard_join, language_id, line_dedup, packing, pii
from phaselens.llm.queries import vocabulary
from phaselens.llm.runtime import settle
from phaselens.plans.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    ship(spark)
    return language_id.keep_identified(docs).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one matches go; n_chars follows. Documents stay, with an empty text if all their lines go."""
    kept = line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest doc_id stays."""
    ship(spark)
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language identification", identified),
    ("line deduplication", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("personal data", without_personal_data),
    ("best-fit packing", packed),
]

#: Statistical models and packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``: toxic documents go, then lines that recur, near copies
and personal data; what stays is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes every stage's rows to the shared checkpoint folder and reads
them again, so a lost executor costs one stage's work at most.

Every stage reads texts whole, keeps rows with a null id or text unless it says otherwise, treats
repeated rows alike, gives an empty table for an empty one, and leaves columns besides text and
n_chars as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm import (kn_toxicity, line_templates, pii_votes, simhash_balls, sumsq_packing)
from loadcast.llm.common import spark_cores
from loadcast.session import ensure_checkpoint_dir


def _with_text_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars``, where there is such a column, follows the changed text."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))
    return df.select(*columns)


def _in_few_files(df: DataFrame, docs: DataFrame) -> DataFrame:
    """At most as many partitions as ``docs`` has, so that a stage behind a shuffle doesn't write
    a file for each of the session's shuffle partitions (see ``loadcast.llm.common.stored``)."""
    return df.coalesce(max(docs.rdd.getNumPartitions(), spark_cores(df.sparkSession)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; a null or empty text has the score of a
    text without words and stays if that is under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = kn_toxicity.score_documents(docs, labels, name="_llm_score")
    return scored.where("_llm_score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; a document of which nothing but white
    space is left goes as a whole. A null or empty text stays."""
    left = line_templates.drop_recurring_lines(docs).where(
        "not (_llm_dropped > 0 and trim(both ' \t\r\n' from text) = '') or text is null")
    return _in_few_files(_with_text_length(left, docs.columns), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. All texts without words (null and empty ones)
    are one group, of which one row stays."""
    return _in_few_files(simhash_balls.keep_one_of_each_group(docs, 3, 3), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data read as their kind in angle brackets; a null text stays null."""
    return _with_text_length(pii_votes.redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null or empty text is its end
    id alone."""
    import public_tokenizers
    return sumsq_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]

#: no stage can be written in SQL: a fitted model, a template tree's hashes, XXH64 fingerprints,
#: fitted span weights and a tokenizer; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, from the ``documents`` table."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

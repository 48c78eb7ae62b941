"""The corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Each stage works on all rows that the one before kept, and is written as Parquet before
the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm import decontaminate, language_id, ngram_join, packing, substring_dedup
from matlink.llm.common import free_name, shared_dir, with_likely


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Those without letters, or with no text, go; a null lang is filled in."""
    found = language_id.identify(docs, language_id.train(docs)).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike in five-word shingles by 0.8 or more, that of the smallest id stays.

    Rows that repeat an id are one document; rows with a null id stay unless they are like
    one with an id.
    """
    members, _ = ngram_join.jaccard_classes(docs.select("doc_id", "text"), words=5, percent=80)
    own = free_name(docs.columns, "__own")
    hit, of = f"{own}0", f"{own}1"
    gone = members.where("doc_id <> component_id").select(F.col("doc_id").alias(of)).distinct()
    marked = with_likely(docs, hit, F.col("doc_id"), gone, of)
    rest = marked.where(F.col(hit)).join(gone, F.col("doc_id") == F.col(of), "left_anti")
    return marked.where(~F.col(hit)).unionByName(rest).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that start earlier, too."""
    done = substring_dedup.dedup_substrings(docs, window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5 % lie in passages of benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).where(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, *packing.public_files())


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: SQL can express neither tokenising nor the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the last one's rows."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

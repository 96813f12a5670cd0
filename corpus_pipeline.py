"""Corpus cleaning in stages, each over all documents that its predecessor kept.

The quality classifier and language identification let documents go, the n-gram join leaves one document of each group,
passages that repeat across documents are cut, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankintel.llm import language, ngram_join, packing, quality, substring
from rankintel.llm.shared import bounded_batches, stored

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; null and empty texts go, other columns may have any names."""
    bounded_batches(spark)
    return quality.good_only(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told: null texts and those without a single letter go.

    Without any labelled document nothing can be told, and nothing stays.
    """
    bounded_batches(spark)
    return language.determined_only(docs, language.learn(docs.where(~language.held_out(F.col("doc_id")))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows that share an id are one document: of them the one with the smallest hash of all columns stays, whatever their
    texts. Rows without an id belong to no group and stay. Documents without words are in no group and stay.
    """
    bounded_batches(spark)
    found = ngram_join.components_of(docs)
    ids = found.where("component_id = doc_id").select("doc_id").distinct()
    # The columns go through the join as one, under a name that none of them can clash with.
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row")).withColumn("at", F.xxhash64("row"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    kept = rows.join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi").withColumn("rank", first).where("rank = 1")
    return kept.select("row.*").union(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document with a smaller id has too; null texts stay null."""
    bounded_batches(spark)
    return substring.cut(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is the empty text."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifiers nor packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The corpus pipeline: from raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from docsift.llm.common import stored, unwrapped, wrapped


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(judged: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that were kept, each by the verdict on itself, whatever its id; ``doc`` is the whole row."""
    return unwrapped(judged.where("kept").withColumnRenamed("doc", "row"), columns)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects: of no quality, or toxic."""
    model = quality_classifier.fit_labelled(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "labels"))
    return _kept(quality_classifier.graded(wrapped(docs, text="text"), "row", "text", model), docs.columns)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    trees = quality_rules.fit_rules(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "labels"))
    return _kept(quality_rules.judged(wrapped(docs, text="text"), "row", "text", trees), docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without later copies of line runs; ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs, "doc_id", "text").drop("lines", "deleted_lines")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that with the smallest id."""
    return simhash.without_near_duplicates(docs, "doc_id", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(docs, "doc_id", "text", path).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("best_fit_packing", packed),
]

# SQL has neither the models nor the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``; each result is written as Parquet and read by the next."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

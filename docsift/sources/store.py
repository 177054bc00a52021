"""The document collection as a Parquet table partitioned by document type."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docsift.functions.files import match_label
from docsift.schema import DOCUMENT_SCHEMA, conform


# Bloom filters per row group let a lookup by id skip the row groups without it.
_ID_FILTERS = {
    f"parquet.bloom.filter.{option}#{column}": value
    for column in ("row_id", "doc_id")
    for option, value in (("enabled", "true"), ("expected.ndv", "100000"))
}


def append_documents(docs: DataFrame, path: str, schema: str = DOCUMENT_SCHEMA) -> None:
    """Append; documents that are already there are stored a second time.

    ``row_id`` is the document id and the id of this load, so that copies of a
    document stay apart.
    """
    row_id = F.concat("doc_id", F.lit(f":{uuid.uuid4().hex}"))
    stored = conform(docs.withColumn("row_id", row_id), schema)
    stored.write.mode("append").options(**_ID_FILTERS).partitionBy("type").parquet(path)


def open_documents(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def newest_documents(docs: DataFrame, loaded_at: str, key: str = "doc_id") -> DataFrame:
    """The newest row of every key.

    ``row_number <= 1`` is cut per input partition before the shuffle, so a
    document with very many versions sends one row per partition.
    """
    newest = Window.partitionBy(key).orderBy(F.col(loaded_at).desc())
    return docs.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def upsert_documents(current: DataFrame, incoming: DataFrame, target: str, key: str = "doc_id") -> None:
    """Write current and incoming rows to a new path, incoming rows replacing current ones of the same key.

    Incoming documents get the current table's columns and a ``row_id`` of this load where it has one. Of two
    incoming rows with one key the first by its values stays. Only the ids of the incoming rows meet the
    current ones, so that stored content and vectors are not shuffled while those ids are few.
    """
    if "row_id" in current.columns:
        incoming = incoming.withColumn("row_id", F.concat("doc_id", F.lit(f":{uuid.uuid4().hex}")))
    fresh = conform(incoming, ", ".join(f"{name} {kind}" for name, kind in current.dtypes))
    same = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(c) for c in fresh.columns if c != "row_id"]))
    fresh = fresh.withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n")
    kept = current.join(incoming.select(key).distinct(), key, "left_anti").select(fresh.columns)
    kept.unionByName(fresh).write.mode("overwrite").options(**_ID_FILTERS).partitionBy("type").parquet(target)


def clear_documents(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA) -> None:
    """Leave an empty collection at ``path``."""
    spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("type").parquet(path)


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("document_count"))


def api_projection(snippets: Column | None = None) -> list[Column]:
    """The six fields of a search hit."""
    return [
        F.col("filename"),
        F.col("path").alias("filepath"),
        F.substring("content", 1, 300).alias("content_preview"),
        match_label(F.col("match_source")).alias("match_type"),
        F.col("embedding_type"),
        F.slice(F.col("snippets") if snippets is None else snippets, 1, 3).alias("snippets"),
    ]


def hits_as_json(hits: DataFrame) -> DataFrame:
    """One JSON object per hit."""
    return hits.select(F.to_json(F.struct(*api_projection())).alias("json"))

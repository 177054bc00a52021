"""Reports over a document table or over an indexing run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docsift.functions.files import SIZE_CATEGORIES, format_size, human_time

SLOW_SECONDS = 0.5


def index_summary(processed: DataFrame) -> DataFrame:
    """One row of counts over the per-file status table; empty files also count as failed."""
    status = F.col("status")
    added = status == "added"
    bert = F.coalesce(F.col("embedding_type") == "bert", F.lit(False))
    return processed.agg(
        F.count_if(added).alias("added"),
        F.count_if(status == "empty").alias("empty"),
        F.count_if(added & (F.col("match_source") == "file_content")).alias("content_matches"),
        F.count_if(added & (F.col("match_source") == "metadata_only")).alias("metadata_matches"),
        F.count_if(added & bert).alias("bert_embedded"),
        F.count_if(added & ~bert).alias("other_embedded"),
        F.count_if(~added).alias("failed"),
    )


def corpus_totals(docs: DataFrame, size: str = "size_bytes") -> DataFrame:
    totals = docs.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
    mean = F.col("total_bytes") / F.when(F.col("total_files") > 0, F.col("total_files"))
    return totals.select(
        "total_files",
        "total_bytes",
        mean.alias("average_bytes"),
        format_size(F.col("total_bytes")).alias("total_size"),
        format_size(mean).alias("average_size"),
    )


def size_histogram(docs: DataFrame, category: str = "size_category") -> DataFrame:
    """Files per size class in the order of sizes; empty classes are left out."""
    names = F.array(*[F.lit(name) for name, _ in SIZE_CATEGORIES])
    place = F.array_position(names, F.col(category)).cast("bigint")
    counts = docs.groupBy(F.col(category).alias("size_category")).agg(F.count("*").alias("files"))
    return counts.withColumn("position", place).filter(F.col("position") > 0).orderBy("position")


def type_distribution(docs: DataFrame, kind: str = "type") -> DataFrame:
    """Files and share of each document type, most frequent first."""
    counts = docs.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("type")).agg(F.count("*").alias("files"))
    # One row per document type is left, so one window over all is small.
    share = F.col("files") * 100.0 / F.sum("files").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", share).orderBy(F.col("files").desc(), "type")


def oldest_newest(docs: DataFrame, created: str = "created_time", name: str = "filename", path: str = "path") -> DataFrame:
    """Oldest and newest file; the first path wins among equal times."""
    moment = F.unix_micros(F.col(created))
    known = docs.filter(F.col(created).isNotNull())
    facts = F.struct(F.col(name).alias("name"), F.col(created).alias("at"))
    ends = known.agg(
        F.min_by(facts, F.struct(moment.alias("t"), F.col(path))).alias("oldest"),
        F.min_by(facts, F.struct((-moment).alias("t"), F.col(path))).alias("newest"),
    )
    return ends.select(
        F.col("oldest.name").alias("oldest_file"),
        human_time(F.col("oldest.at")).alias("oldest_date"),
        F.col("newest.name").alias("newest_file"),
        human_time(F.col("newest.at")).alias("newest_date"),
    )


def timing_summary(timings: DataFrame, seconds: str, total_seconds: Column | None = None) -> DataFrame:
    """Count, mean, least, greatest and sum of per-file seconds, and files per second.

    The rate is over ``total_seconds`` of the whole run where given.
    """
    spent = F.sum(seconds) if total_seconds is None else total_seconds
    return timings.agg(
        F.count(seconds).alias("files"),
        F.avg(seconds).alias("avg_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
        F.sum(seconds).alias("total_seconds"),
        (F.count(seconds) / F.when(spent > 0, spent)).alias("files_per_second"),
    )


def slowest_files(timings: DataFrame, seconds: str, name: str, top: int = 5) -> DataFrame:
    """The slowest files, or none at all if even the slowest was quick."""
    slowest = timings.select(name, seconds).orderBy(F.col(seconds).desc(), name).limit(top)
    # The window sees the few rows that are left.
    worst = F.max(seconds).over(Window.partitionBy(F.lit(0)))
    return slowest.withColumn("__worst", worst).filter(F.col("__worst") > SLOW_SECONDS).drop("__worst")

"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows spread over all cores if the input has fewer splits than cores.

    For costly row-by-row work on a small file that would be one task. A large
    input has more splits than cores and is returned as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

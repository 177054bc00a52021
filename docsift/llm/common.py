"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows of one Arrow batch are worked on in pieces of about this many characters, so that the
# memory of a Python worker does not follow the number of rows in a batch.
CHUNK_CHARS = 4_000_000
HOT_SHARE = 4096  # a key with more than this part of all rows is looked up by broadcast; so many keys at most


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that the session names in ``spark.checkpoint.dir``.

    Only a session without that setting, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docsift-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once, written to the shared folder and read from there.

    A lost executor costs the tasks that it ran, not the jobs before them. The results of the operators read
    these tables lazily; ``clear_scratch`` removes them, at the latest when Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clear_scratch() -> None:
    """Removes every table that ``stored`` wrote in this process."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        if spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Sends an object of this package to the tasks, which make it by calling the result.

    A plain broadcast names the classes of its objects, so that a worker would need the package; this has them inside.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wrapped(df: DataFrame, **columns: str) -> DataFrame:
    """The whole row as the struct ``row`` beside the named columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"), *[
        F.col(f"`{column}`").alias(name) for name, column in columns.items()
    ])


def unwrapped(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows that ``wrapped`` put away, with some columns changed."""
    return df.select(*[changed.get(name, F.col("row").getField(name)).alias(name) for name in columns])


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """The inner join with a table whose keys are unique. Rows with a key that very many rows have are not shuffled.

    There are at most HOT_SHARE such keys; their rows of the table travel with the tasks.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"))
    hot = stored(sizes.where(F.col("size") > rows.count() / HOT_SHARE).select(*keys), "hot")
    own = table.join(F.broadcast(hot), keys, "left_semi")
    often = rows.join(F.broadcast(own), keys)
    return often.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(texts: list[str | None]) -> list[tuple[int, int]]:
    """Ranges of rows with about CHUNK_CHARS characters each; a longer text is a range of its own."""
    out, begin, size = [], 0, 0
    for at, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= CHUNK_CHARS:
            out.append((begin, at + 1))
            begin, size = at + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, type=field.type)
        for column, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def concatenated_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then the same for starts[1] and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def one_text_each(docs: DataFrame, id_column: str, text_column: str, sample: DataFrame) -> DataFrame:
    """The rows of ``sample`` (``key`` and more, bounded) with a ``text``: of several texts of an id that with the smallest hash.

    So a sample has as many texts as rows, however many documents an id has. Null texts come last.
    """
    # as long as the sample is bounded, so is what travels with the tasks
    found = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text")).join(F.broadcast(sample), F.col("doc") == F.col("key"))
    text = F.min_by(F.struct("text"), F.struct(F.col("text").isNull(), F.xxhash64("text"), F.hash("text"))).alias("t")
    return found.groupBy(*sample.columns).agg(text).select(*sample.columns, "t.text")


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of the keys, the same ones in every run."""
    total = df.count()
    if total <= rows:
        return df
    share = int(1_000_000 * rows / total)
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < share)

"""Turning text into vectors.

An embedder is a Column-to-Column function. The default hashes words into a
fixed number of buckets, so that results can be recomputed anywhere; a real
model plugs in as a pandas UDF with the same shape.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

Embedder = Callable[[Column], Column]

DIMENSION = 256
# Words whose buckets a task remembers; with more, it begins anew.
_REMEMBERED_WORDS = 150_000
_ROWS_AT_ONCE = 256


class _WordCounter:
    """Word counts per row and hash bucket, remembering the buckets of words."""

    def __init__(self, dim: int):
        self.dim = dim
        self.seen: dict[str, int] = {}
        self.words_of = re.compile("[a-z0-9_]+").findall

    def bucket(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= _REMEMBERED_WORDS:
                self.seen.clear()
            found = self.seen[word] = int(md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return found

    def keys(self, texts: pa.Array) -> np.ndarray:
        """``row * dim + bucket`` of every word of every row."""
        words, sizes = [], []
        for text in texts.to_pylist():
            own = self.words_of(text or "")
            words += own
            sizes.append(len(own))
        coded = pa.array(words, pa.string()).dictionary_encode()
        buckets = np.array([self.bucket(word) for word in coded.dictionary.to_pylist()], dtype=np.int64)
        rows = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        return rows * self.dim + (buckets[coded.indices.to_numpy()] if words else rows)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    return (texts.slice(start, _ROWS_AT_ONCE) for start in range(0, len(texts), _ROWS_AT_ONCE))


@cache
def _dense_udf(dim: int):
    @F.arrow_udf(ArrayType(FloatType()))
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter, kind = _WordCounter(dim), pa.list_(pa.float32())

        def vectors(texts: pa.Array) -> pa.Array:
            counts = np.bincount(counter.keys(texts), minlength=len(texts) * dim).reshape(len(texts), dim)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            units = (counts / np.where(length == 0, 1.0, length)).astype(np.float32)
            offsets = np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)
            return pa.ListArray.from_arrays(offsets, units.ravel(), mask=texts.is_null() if texts.null_count else None)

        for texts in batches:
            yield pa.concat_arrays([vectors(part) for part in _parts(texts)]) if len(texts) else pa.array([], kind)

    # So marked, a later filter is not pushed below it, which would run it twice.
    return hashed.asNondeterministic()


@cache
def _sparse_udf(dim: int):
    entry = StructType([StructField("bucket", IntegerType()), StructField("weight", DoubleType())])
    arrow_kind = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float64())]))

    @F.arrow_udf(ArrayType(entry))
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _WordCounter(dim)

        def vectors(texts: pa.Array) -> pa.Array:
            keys, counts = np.unique(counter.keys(texts), return_counts=True)
            rows = keys // dim
            power = np.bincount(rows, weights=counts * counts, minlength=len(texts))
            entries = pa.StructArray.from_arrays(
                [pa.array((keys % dim).astype(np.int32)), pa.array(counts / np.sqrt(power)[rows])], ["bucket", "weight"]
            )
            offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(offsets, entries)

        for texts in batches:
            yield pa.concat_arrays([vectors(part) for part in _parts(texts)]) if len(texts) else pa.array([], arrow_kind)

    return hashed.asNondeterministic()


def _clean(text: Column) -> Column:
    return F.lower(text)


def hashed_embedding(text: Column, dim: int = DIMENSION) -> Column:
    """Unit-length word-hash vector; all zero for a text without words.

    Bucket of a word: first 32 bits of its md5, modulo ``dim``. The whole text
    counts; an embedder with a context limit has to cut or split texts itself.
    """
    return _dense_udf(dim)(_clean(text))


def hashed_terms(text: Column, dim: int = DIMENSION) -> Column:
    """The same vector as its non-zero ``(bucket, weight)`` entries, in double."""
    return _sparse_udf(dim)(_clean(text))


def embed(df: DataFrame, text: str = "content", out: str = "embedding", embedder: Embedder = hashed_embedding) -> DataFrame:
    return df.withColumn(out, embedder(F.col(text)))


def embed_by_type(
    df: DataFrame,
    text_embedder: Embedder,
    other_embedder: Embedder,
    text: str = "content",
    type_col: str = "type",
    out: str = "embedding",
) -> DataFrame:
    """Text rows through one embedder, others (and its failures) through another.

    Both must give vectors of one space. Each embedder sees null for rows that
    are not its own, so no row is encoded twice unless the first one failed.
    """
    is_text = F.coalesce(F.col(type_col) == "text", F.lit(False))
    first = df.withColumn("__first", text_embedder(F.when(is_text, F.col(text))))
    got = is_text & F.col("__first").isNotNull()
    second = first.withColumn("__second", other_embedder(F.when(~got, F.col(text))))
    return second.withColumn(out, F.when(got, F.col("__first")).otherwise(F.col("__second"))).drop("__first", "__second")

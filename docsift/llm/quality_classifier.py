"""Quality classifier: ordinal regression with cumulative links on hashed text.

A document has a grade 0, 1, .. K-1. One weight per hashed feature is shared by all grades, and K-1 ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). The expected grade and the probability of
the best grades follow. The model is fitted on hashed features of a bounded sample and sent to the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docsift.llm.common import batch_of, bounded_sample, chunks, one_text_each, shipped

BITS = 20
PREFIX = 4  # bytes of a word that are a feature of their own
SAMPLE_ROWS = 20_000
TAIL_GRADE, TAIL_AT_LEAST = 2, 0.5
_STRIP = b".,;:!?\"'()[]{}#*$%&|<>"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def hashed_features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted hashes of the different words (A-Z lower-cased, without marks around them), their first bytes, and the text's shape.

    The shape are shares of upper case, digits, symbols, exclamation marks, short and repeated words, each in one of
    a few steps. A text without words has the one feature ``empty``.
    """
    raw = text.encode() if text else b""
    words = raw.lower().split()
    if not words:
        return np.array([zlib.crc32(b"empty") & ((1 << bits) - 1)], np.int32)
    distinct = set(words)
    shape = {
        "upper": (len(raw) - len(raw.translate(None, _UPPER))) / len(raw),
        "digit": (len(raw) - len(raw.translate(None, _DIGITS))) / len(raw),
        "symbol": (len(raw) - len(raw.translate(None, b"#*$%&|<>"))) / len(words),
        "mark": raw.count(b"!") / len(words),
        "repeated": 1 - len(distinct) / len(words),
        "lines": raw.count(b"\n") / len(words),
    }
    steps = [f"{name} {int(4 * np.log2(1 + 255 * min(share, 1.0)))}".encode() for name, share in shape.items()]
    tokens = {word.strip(_STRIP) for word in distinct}
    tokens |= {b"^" + token[:PREFIX] for token in tokens}
    mask = (1 << bits) - 1
    return np.unique(np.array([zlib.crc32(t) & mask for t in [*tokens, *steps]], np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def scores(self, indices: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0.0], np.cumsum(self.weights[indices], dtype=float)])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return np.diff(ends[bounds])

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0..K-2, a column each."""
        return 1 / (1 + np.exp(scores[:, None] - self.thresholds[None, :]))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return (1 - self.at_most(scores)).sum(axis=1)

    def tail(self, scores: np.ndarray, grade: int) -> np.ndarray:
        return 1 - self.at_most(scores)[:, grade - 1]


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, count: int, bits: int = BITS, passes: int | None = None, batch: int = 128,
    alpha: float = 1.0, l1: float | None = None, l2: float = 0.1, seed: int = 7,
) -> OrdinalModel:
    """Follow-the-regularised-leader steps on the negative log likelihood; thresholds stay in order.

    A strong first-order penalty leaves only features with a steady effect, so that the many words of a long text
    do not add up to noise. It follows the root of the number of documents, as such noise does. Rare grades weigh
    more, by the root of their share.
    """
    l1 = 0.7 * np.sqrt(len(grades)) if l1 is None else l1
    passes = int(np.clip(100_000 / max(len(grades), 1), 12, 80)) if passes is None else passes
    weight = np.sqrt(len(grades) / (count * np.maximum(np.bincount(grades, minlength=count), 1)))
    size = 1 << bits
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    known = np.cumsum(np.bincount(grades, minlength=count) + 1.0) / (len(grades) + count)
    thresholds = np.log(known[:-1] / (1 - known[:-1]))
    squares = np.full(count - 1, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in own])
            used, place = np.unique(np.concatenate([rows[i] for i in own]), return_inverse=True)
            owner = np.repeat(np.arange(len(own)), lengths)
            scores = np.bincount(owner, w[used][place], len(own))
            inner = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds, -30, 30)))
            below = np.concatenate([np.zeros((len(own), 1)), inner, np.ones((len(own), 1))], axis=1)
            each, y = np.arange(len(own)), grades[own]
            low, high = below[each, y], below[each, y + 1]
            slope = weight[y] * (1 - low - high)  # of the loss by the score
            grad = np.bincount(place, slope[owner], len(used))
            step = (np.sqrt(n[used] + grad**2) - np.sqrt(n[used])) / alpha
            z[used] += grad - step * w[used]
            n[used] += grad**2
            zu = z[used]
            w[used] = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((1 + np.sqrt(n[used])) / alpha + l2))
            part = np.maximum(high - low, 1e-9) / weight[y]
            by = np.zeros(count + 1)
            np.add.at(by, y + 1, -high * (1 - high) / part)
            np.add.at(by, y, low * (1 - low) / part)
            by = by[1:-1]
            squares += by**2
            thresholds = thresholds - 0.3 * by / np.sqrt(squares)
            for k in range(1, count - 1):
                thresholds[k] = max(thresholds[k], thresholds[k - 1] + 1e-3)
    return OrdinalModel(w.astype(np.float32), thresholds, bits)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for a document of no quality, 1 for a good one that is toxic, 2 for a good one that is not."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when((quality == 1) & (toxic == 0), 2)


def fit_classifier(
    docs: DataFrame, id_column: str, text_column: str, grades: DataFrame, grade_column: str = "grade",
    sample_rows: int = SAMPLE_ROWS, bits: int = BITS, count: int = 3,
) -> OrdinalModel:
    """Fits on at most about ``sample_rows`` graded ids, chosen by a hash, and one text of each.

    A text has 2^bits features at most.

    Null grades and grades outside 0..count-1 are no grades. Without any graded document all scores are 0.
    """
    named = grades.select(grades[f"`{id_column}`"].alias("key"), grades[f"`{grade_column}`"].cast("long").alias("grade"))
    sample = bounded_sample(named.where(F.col("grade").between(0, count - 1)).dropna().distinct(), ["key"], sample_rows)
    joined = one_text_each(docs, id_column, text_column, sample).select(F.col("key").alias("doc"), "grade", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("grade", pa.int64()), ("features", pa.list_(pa.int32()))])
            yield batch_of(schema, [batch.column(0), batch.column(1), [hashed_features(t, bits) for t in batch.column(2).to_pylist()]])

    kind = dict(joined.dtypes)["doc"]
    hashed = joined.mapInArrow(work, f"doc {kind}, grade long, features array<int>")
    table = hashed.orderBy(F.xxhash64("doc"), "doc", "grade").toArrow()
    rows = [np.asarray(row.values) for row in table.column("features")]
    return fit_ordinal(rows, table.column("grade").to_numpy().astype(np.int64), count, bits)


def fit_labelled(docs: DataFrame, id_column: str, text_column: str, labels: DataFrame) -> OrdinalModel:
    """``fit_classifier`` on the grades that ``quality`` and ``toxic`` of the labels make."""
    grade = grade_of(F.col("quality"), F.col("toxic")).alias("grade")
    return fit_classifier(docs, id_column, text_column, labels.select(id_column, grade))


def graded(
    docs: DataFrame, id_column: str, text_column: str, model: OrdinalModel, tail_grade: int = TAIL_GRADE, at_least: float = TAIL_AT_LEAST
) -> DataFrame:
    """``doc``, ``expected_grade``, ``tail_probability`` (of ``tail_grade`` or better) and ``kept`` of every row.

    A row is kept if the tail probability is ``at_least`` or more. Null and empty texts are judged by their one
    feature. Rows are judged each on their own, whatever their id; whole texts are read.
    """
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text"))
    shared = shipped(docs.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            schema = pa.schema([batch.schema.field(0), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])
            for begin, end in chunks(texts):
                found = [hashed_features(t, own.bits) for t in texts[begin:end]]
                scores = own.scores(np.concatenate(found), np.array([len(f) for f in found]))
                tail = own.tail(scores, tail_grade)
                yield batch_of(schema, [batch.column(0)[begin:end], own.expected(scores), tail, tail >= at_least])

    return rows.mapInArrow(work, f"doc {dict(rows.dtypes)['doc']}, expected_grade double, tail_probability double, kept boolean")

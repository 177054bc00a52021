"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The statistics of every whole text are counted in the tasks. The trees are fitted on the statistics (not the
texts) of a bounded sample of labelled documents, flattened into arrays and sent to the tasks for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import batch_of, bounded_sample, chunks, one_text_each, shipped

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct")
SYMBOLS = "#*$%&|<>"
_SPACES, _MARKS = " \t\n\x0b\x0c\r", "!?"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))

# Features made of the counts, and whether the score may only rise (1) or fall (-1) with one.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines_per_word": -1, "repeated_share": -1,
    "upper_share": -1, "digit_share": 0, "marks_per_word": -1, "distinct_share": 1,
}
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS for a text; words are what stands between ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    repeated = _repeat_words(words) if len(triples) < n - 2 else 0
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        sum(map(text.count, _MARKS)),
        len(set(words)),
    )


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that occurs twice or more."""
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 3, np.int32)
    for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        first = seen.setdefault(window, at)
        if first != at:
            covered[at] += 1
            covered[at + 3] -= 1
            if first >= 0:
                covered[first] += 1
                covered[first + 3] -= 1
                seen[window] = -1
    return int((np.cumsum(covered) > 0).sum())


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of FEATURES from rows of COUNTS."""
    n, chars, symbols, dup, repeated, upper, digits, marks, distinct = counts.T.astype(float)
    words, chars = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([
        np.log1p(n), chars / words, symbols / words, dup / words, repeated / words, upper / chars, digits / chars,
        marks / words, distinct / words,
    ], axis=1)


@dataclass
class Trees:
    """All trees in flat arrays: a node sends a row left if its feature is at most the threshold; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0
) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    ``signs``: 1 or -1 for a feature the score may only rise or fall with. A split against it is not made, and the
    leaves under a split stay on their side of the middle of its two values.
    """
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) if len(y) else np.zeros(0) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), rate * value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        value = lambda g, h: np.clip(-g / (h + ridge), low, high)
        gain = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
        here = value(g, h)
        if level < depth and len(rows) >= 20:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                own = binned[rows, f]
                gl = np.cumsum(np.bincount(own, grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(own, hess[rows], len(e) + 1))[:-1]
                vl, vr = value(gl, hl), value(g - gl, h - hl)
                won = gain(gl, hl, vl) + gain(g - gl, h - hl, vr) - gain(g, h, here)
                won[(hl < 1) | (h - hl < 1) | (signs[f] * (vr - vl) < 0)] = -np.inf
                at = int(np.argmax(won))
                if won[at] > best[0]:
                    best = (won[at], (f, at, vl[at], vr[at]))
        if best[1] is None:
            chosen = leaf(float(here))
            margin[rows] += nodes[chosen][4]
            return chosen
        f, at, vl, vr = best[1]
        own, middle = len(nodes), (vl + vr) / 2
        nodes.append([f, float(edges[f][at]), 0, 0, 0.0])
        goes = binned[rows, f] <= at
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
        nodes[own][2] = grow(rows[goes], grad, hess, level + 1, *bounds[0])
        nodes[own][3] = grow(rows[~goes], grad, hess, level + 1, *bounds[1])
        return own

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    kinds = (np.int32, float, np.int32, np.int32, float)
    return Trees(*(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), np.array(roots, np.int32), depth, base)


def counted(docs: DataFrame, id_column: str, text_column: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc``, the columns named in ``more`` (as m0, m1, ...) and COUNTS of every row."""
    return _map_counts(docs, id_column, text_column, more, None, THRESHOLD)


def _map_counts(docs, id_column, text_column, more, trees, threshold) -> DataFrame:
    rows = docs.select(
        docs[f"`{id_column}`"].alias("doc"), *[docs[f"`{c}`"].alias(f"m{n}") for n, c in enumerate(more)], docs[f"`{text_column}`"].alias("text")
    )
    model = None if trees is None else shipped(docs.sparkSession, trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if model is None else model()
        for batch in batches:
            texts = batch.column(len(more) + 1).to_pylist()
            schema = pa.schema([batch.schema.field(n) for n in range(len(more) + 1)] + [(c, pa.int64()) for c in COUNTS] + (
                [] if own is None else [("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]))
            for begin, end in chunks(texts):
                counts = np.array([text_counts(t) for t in texts[begin:end]], np.int64)
                columns = [batch.column(n)[begin:end] for n in range(len(more) + 1)] + list(counts.T)
                if own is not None:
                    failed = base_failed(counts[:, 0], counts[:, 4])
                    score = own.probability(features(counts))
                    columns += [failed, score, ~failed & (score >= threshold)]
                yield batch_of(schema, columns)

    types = dict(rows.dtypes)
    schema = [f"{c} {types[c]}" for c in rows.columns[:-1]] + [f"{c} long" for c in COUNTS]
    schema += [] if trees is None else ["base_failed boolean", "score double", "kept boolean"]
    return rows.mapInArrow(work, ", ".join(schema))


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def fit_rules(
    docs: DataFrame, id_column: str, text_column: str, labels: DataFrame, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Trees:
    """Trees that tell documents of label 1 from those of label 0.

    Fitted on at most about ``sample_rows`` labelled ids, chosen by a hash, and one text of each; null labels are no labels.
    Without labelled documents every score is 0.5.
    """
    named = labels.select(labels[f"`{id_column}`"].alias("key"), labels[f"`{label_column}`"].cast("long").alias("label"))
    sample = bounded_sample(named.dropna().distinct(), ["key"], sample_rows)
    joined = one_text_each(docs, id_column, text_column, sample)
    table = counted(joined, "key", "text", ("label",)).orderBy(F.xxhash64("doc"), "doc", "m0").toArrow()
    counts = np.stack([table.column(c).to_numpy() for c in COUNTS], axis=1) if table.num_rows else np.zeros((0, len(COUNTS)), np.int64)
    y = table.column("m0").to_numpy().astype(float) if table.num_rows else np.zeros(0)
    return fit_trees(features(counts), y, list(FEATURES.values()))


def judged(docs: DataFrame, id_column: str, text_column: str, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc``, COUNTS, ``base_failed``, ``score`` and ``kept`` of every row.

    Null and empty texts have no words, so they fail the base rules. Rows are judged each on their own, whatever their
    id. Whole texts are counted; memory of a task: one text, or about 4 million characters.
    """
    return _map_counts(docs, id_column, text_column, (), trees, threshold)

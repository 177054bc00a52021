"""Exact nearest neighbours of one or many query vectors.

Exact search never builds query-by-document rows. Every task scores its own
vectors against the queries with a matrix product and emits at most ``k``
candidates per query; only those are shuffled and ranked. Few queries travel
with the task. When they are too many for that, both sides are cut into blocks
and each pair of blocks is scored in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

METRICS = ("l2", "cosine", "dot")
SCORE_DIGITS = 10
# At most this much query data travels with each task.
MAX_SHIPPED_BYTES = 32 * 1024 * 1024
# Candidates are ranked within so many groups of tasks before the last ranking.
RANK_GROUPS = 1024
EVERY_SCORE = (-np.inf, np.inf)
BLOCK_BYTES = 64 * 1024 * 1024
# A task scores tiles of at most so many rows and queries, whose values are at most so many on each side.
_TILE_SIDE = 1024
_CHUNK_VALUES = 1_000_000
# Queries of up to so many values stay a matrix, others are made one for each tile.
_HELD_VALUES = 8_000_000
# More queries than these are cut into blocks, so that their work is spread whatever the partitions of the documents are.
MAX_SHIPPED_QUERIES = 4096
# Blocks are cut until a pair of them has at most so many pairs of rows, or until each core has so many pairs of blocks.
BLOCK_PAIRS, BLOCKS_PER_CORE = 50_000_000, 2
_ARROW_IDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

# Makes, from the query vectors, the number of columns and a function that turns
# vectors of both sides into rows of these columns.
Scorer = Callable[[pa.Array], tuple[int, Callable[[pa.Array], np.ndarray]]]


def dense_matrix(vectors: pa.Array) -> np.ndarray:
    """Equal-length float lists as rows of a double matrix."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1) if len(vectors) else values.reshape(0, 0)


def _dense_scorer(queries: pa.Array):
    return len(queries[0]) if len(queries) else 0, dense_matrix


def _sparse_scorer(queries: pa.Array):
    """Columns are the buckets that occur in a query; no other bucket can score."""
    used = np.unique(queries.flatten().field("bucket").to_numpy())

    def rows(vectors: pa.Array) -> np.ndarray:
        entries = vectors.flatten()
        buckets = entries.field("bucket").to_numpy()
        owners = np.repeat(np.arange(len(vectors)), vectors.value_lengths().to_numpy())
        place = np.minimum(np.searchsorted(used, buckets), max(0, len(used) - 1))
        hit = used[place] == buckets if len(used) else np.zeros(len(buckets), dtype=bool)
        out = np.zeros((len(vectors), len(used)))
        out[owners[hit], place[hit]] = entries.field("weight").to_numpy()[hit]
        return out

    return len(used), rows


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)


def _null_first(key) -> tuple:
    return () if key is None else (key,)


def _plain_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as an array without nulls, and which of them are not null: in this order null ids come first, as in a sort by Spark."""
    text = pa.types.is_string(ids.type)
    filled = ids.fill_null("" if text else 0).to_numpy(zero_copy_only=False)
    return filled if text else filled.astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)


class _Best:
    """The ``k`` nearest ids of each query among the rows seen so far whose cost lies within the limits.

    Rows and queries meet in tiles of a bounded size. Queries are turned into a matrix tile by tile where all of them would be too large.
    """

    def __init__(self, query_ids: pa.Array, query_vectors: pa.Array, scorer: Scorer, k: int, metric: str, limits: tuple[float, float], id_type: pa.DataType):
        self.query_ids, self.vectors, self.k, self.metric, self.limits, self.id_type = query_ids, query_vectors, k, metric, limits, id_type
        self.width, self.to_rows = scorer(query_vectors)
        self.probe = np.random.default_rng(0).random(self.width)
        n = len(query_ids)
        self.side = max(1, min(_TILE_SIDE, _CHUNK_VALUES // max(1, self.width)))
        self.held = self._matrix(0, n) if n * self.width <= _HELD_VALUES else None
        self.costs = np.full((n, k), np.inf)
        self.ids = np.full((n, k), "", dtype=object) if pa.types.is_string(id_type) else np.zeros((n, k), np.int64)
        self.valid = np.zeros((n, k), dtype=bool)

    def _matrix(self, start: int, end: int) -> np.ndarray:
        rows = self.to_rows(self.vectors.slice(start, end - start))
        return _units(rows) if self.metric == "cosine" else rows

    def _tiles(self) -> Iterator[tuple[int, np.ndarray]]:
        for start in range(0, len(self.query_ids), self.side):
            end = min(start + self.side, len(self.query_ids))
            yield start, self._matrix(start, end) if self.held is None else self.held[start:end]

    def _costs(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Smaller is nearer; rounded, so that equal vectors tie exactly."""
        cost = ((rows - queries) ** 2).sum(axis=1) if self.metric == "l2" else -(rows * queries).sum(axis=1)
        return np.round(cost, SCORE_DIGITS)

    def _rough_costs(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """All costs by one matrix product, good to about 1e-9 of the vectors' power."""
        costs = queries @ rows.T
        if self.metric != "l2":
            return np.negative(costs, out=costs)
        costs *= -2
        costs += (queries**2).sum(axis=1)[:, None]
        costs += (rows**2).sum(axis=1)[None, :]
        return costs

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        if not len(self.query_ids):
            return
        for start in range(0, len(ids), self.side):
            self._add(ids.slice(start, self.side), self.to_rows(vectors.slice(start, self.side)))

    def _without_spare_copies(self, ids: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Of equal vectors only the ``k`` first ids can be hits, as they tie for every query.

        Without this, a large group of copies would be ranked again for every query.
        """
        sums = (rows * self.probe).sum(axis=1)
        _, group, sizes = np.unique(sums, return_inverse=True, return_counts=True)
        spare = []
        for large in np.flatnonzero(sizes > self.k):
            members = np.flatnonzero(group == large)
            copies = members[(rows[members] == rows[members[0]]).all(axis=1)]
            names = ids.take(pa.array(copies)).to_pylist()
            spare += [copies[at] for at in sorted(range(len(names)), key=lambda at: _null_first(names[at]))[self.k :]]
        if not spare:
            return ids, rows
        kept = np.setdiff1d(np.arange(len(rows)), spare)
        return ids.take(pa.array(kept)), rows[kept]

    def _add(self, ids: pa.Array, rows: np.ndarray) -> None:
        rows = _units(rows) if self.metric == "cosine" else rows
        if len(rows) > self.k:
            ids, rows = self._without_spare_copies(ids, rows)
        names, valid = _plain_ids(ids)
        for start, queries in self._tiles():
            rough = self._rough_costs(rows, queries)
            power = max(np.abs(rows).max(initial=0.0), np.abs(queries).max(initial=0.0)) ** 2 * self.width
            slack = 1e-9 * max(1.0, power)
            least, most = self._bounds(rough, start, slack)
            asks, at = np.nonzero((rough <= most[:, None]) & (rough >= least))
            # Where very many rows tie, their exact costs are worked out piece by piece.
            piece = max(1, _CHUNK_VALUES // max(1, self.width))
            for begin in range(0, len(asks), piece):
                own, near = asks[begin : begin + piece], at[begin : begin + piece]
                costs = self._costs(rows[near], queries[own])
                good = (costs >= self.limits[0]) & (costs <= self.limits[1]) & (costs <= self.costs[start + own, -1])
                own, near = own[good], near[good]
                self._merge(start + own, costs[good], names[near], valid[near])

    def _bounds(self, rough: np.ndarray, start: int, slack: float) -> tuple[float, np.ndarray]:
        """The rough cost that a hit has at least, and what it has at most, by query."""
        low, high = self.limits
        most = self.costs[start : start + len(rough), -1].copy()
        unknown = np.flatnonzero(np.isinf(most))
        if len(unknown) and rough.shape[1] >= self.k:
            sure = rough[unknown]
            if self.limits != EVERY_SCORE:
                sure[(sure < low + slack) | (sure > high - slack)] = np.inf
            most[unknown] = np.partition(sure, self.k - 1, axis=1)[:, self.k - 1]
        return low - slack, np.minimum(most, high) + slack

    def _merge(self, asks: np.ndarray, costs: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Take hits into the lists of their queries."""
        if not len(asks):
            return
        touched = np.unique(asks)
        old, place = np.nonzero(~np.isinf(self.costs[touched]))
        old = touched[old]
        asks, costs = np.concatenate([old, asks]), np.concatenate([self.costs[old, place], costs])
        ids, valid = np.concatenate([self.ids[old, place], ids]), np.concatenate([self.valid[old, place], valid])
        order = np.lexsort((ids, valid, costs, asks))
        asks = asks[order]
        rank = np.arange(len(asks)) - np.searchsorted(asks, asks)
        kept = rank < self.k
        asks, rank, order = asks[kept], rank[kept], order[kept]
        self.costs[asks, rank], self.ids[asks, rank], self.valid[asks, rank] = costs[order], ids[order], valid[order]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        asks, place = np.nonzero(~np.isinf(self.costs))
        costs = self.costs[asks, place]
        # "+ 0.0" turns a negative zero into zero.
        scores = (costs if self.metric == "l2" else -costs) + 0.0
        ids = pa.array(self.ids[asks, place], schema.types[1], mask=~self.valid[asks, place])
        return pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(asks)).cast(schema.types[0]), ids, pa.array(scores)], schema=schema)


def _hit_schemas(query_type: str, doc_type: str) -> tuple[str, pa.Schema]:
    arrow = [("query_id", _ARROW_IDS[query_type]), ("doc_id", _ARROW_IDS[doc_type]), ("score", pa.float64())]
    return f"query_id {query_type}, doc_id {doc_type}, score double", pa.schema(arrow)


def _id_type(df: DataFrame) -> str:
    return df.schema[0].dataType.simpleString()


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    merged = column.combine_chunks()
    return pa.concat_arrays(merged.chunks) if isinstance(merged, pa.ChunkedArray) else merged


def _by_dimension(rows, scorer: Scorer):
    """Rows with a vector, dense ones apart by dimension, as pairs of the dimension and its rows.

    This is done here and not by a filter, because a filter would be pushed
    below an embedder and run it a second time.
    """
    sizes = pc.list_value_length(rows.column(1))
    if scorer is not _dense_scorer:
        return [(None, rows.filter(pc.is_valid(sizes)))]
    return [(dim, rows.filter(pc.equal(sizes, dim))) for dim in sorted(n for n in pc.unique(sizes).to_pylist() if n)]


def _candidates(
    corpus: DataFrame, asked: pa.Table, query_type: str, scorer: Scorer, k: int, metric: str,
    limits: tuple[float, float] = EVERY_SCORE,
) -> DataFrame:
    """At most ``k`` candidates per query and input partition."""
    ddl, schema = _hit_schemas(query_type, _id_type(corpus))
    parts = [(dim, _one_chunk(own.column(0)), _one_chunk(own.column(1))) for dim, own in _by_dimension(asked, scorer)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: _Best(ids, vectors, scorer, k, metric, limits, schema.types[1]) for dim, ids, vectors in parts}
        for batch in batches:
            for dim, rows in _by_dimension(batch, scorer):
                if dim in best:
                    best[dim].add(rows.column(0), rows.column(1))
        for found in best.values():
            yield found.batch(schema)

    return corpus.mapInArrow(score, ddl)


def _block_counts(docs: int, asks: int, row_bytes: int, cores: int, least: tuple[int, int] = (1, 1)) -> tuple[int, int]:
    """Blocks of documents and of queries: no block passes ``BLOCK_BYTES``, and there are enough pairs of blocks for all cores."""
    doc_blocks, ask_blocks = (max(own, -(-rows * row_bytes // BLOCK_BYTES)) for own, rows in zip(least, (docs, asks)))
    wanted = min(BLOCKS_PER_CORE * cores, -(-docs * asks // BLOCK_PAIRS))
    while doc_blocks * ask_blocks < wanted:
        if docs * ask_blocks >= asks * doc_blocks:
            doc_blocks += 1
        else:
            ask_blocks += 1
    return doc_blocks, ask_blocks


def _block_candidates(
    corpus: DataFrame, queries: DataFrame, scorer: Scorer, k: int, metric: str, blocks: tuple[int, int],
    limits: tuple[float, float] = EVERY_SCORE,
) -> DataFrame:
    """Candidates per pair of blocks, for any number of queries."""
    ddl, schema = _hit_schemas(_id_type(queries), _id_type(corpus))
    doc_blocks, query_blocks = blocks

    def spread(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        key, vector = df.columns
        return df.select(
            F.col(key).alias("id"),
            F.col(vector).alias("vector"),
            # The partition is part of the hash, so that copies of one id spread too.
            F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other),
        )

    docs = spread(corpus, "doc_block", doc_blocks, "query_block", query_blocks)
    asks = spread(queries, "query_block", query_blocks, "doc_block", doc_blocks)

    def score(doc_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        docs_of, found = dict(_by_dimension(doc_rows.select(["id", "vector"]), scorer)), []
        for dim, asked in _by_dimension(query_rows.select(["id", "vector"]), scorer):
            if dim not in docs_of or not asked.num_rows:
                continue
            best = _Best(_one_chunk(asked["id"]), _one_chunk(asked["vector"]), scorer, k, metric, limits, schema.types[1])
            for batch in docs_of[dim].to_batches():
                best.add(batch["id"], batch["vector"])
            found.append(best.batch(schema))
        return pa.Table.from_batches(found, schema)

    keys = ("doc_block", "query_block")
    # With a number of their own, small partitions are not put together; with more of them than pairs, few pairs share one.
    parts = 4 * doc_blocks * query_blocks
    docs, asks = docs.repartition(parts, *keys), asks.repartition(parts, *keys)
    return docs.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(score, ddl)


def _nearest_first(metric: str) -> list[Column]:
    score = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return [score, F.col("doc_id").asc()]


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The ``k`` best candidates of each query.

    With very many tasks one query's candidates are too many to rank at once,
    so they are first ranked in groups of tasks.
    """
    best = _nearest_first(metric)
    some = Window.partitionBy("query_id", "__group").orderBy(*best)
    grouped = found.withColumn("__group", F.spark_partition_id() % RANK_GROUPS)
    found = grouped.withColumn("__n", F.row_number().over(some)).filter(F.col("__n") <= k).drop("__n", "__group")
    order = Window.partitionBy("query_id").orderBy(*best)
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "doc_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    metric: str = "l2",
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
    blocks: tuple[int, int] | None = None,
    limits: tuple[float, float] = EVERY_SCORE,
) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` nearest vectors of every query.

    The score is the squared distance for ``l2`` (ascending), else the
    similarity (descending). Equal scores are ranked by id. ``limits`` are the
    least and the most distance of a hit (only for ``l2``); they hold before
    the ``k`` nearest are taken. A query is compared with all vectors of its own
    length; ``not_compared`` lists the rows that have no counterpart. ``blocks``, the least numbers of blocks of
    documents and queries, forces the way for many queries.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return _search(
        corpus.select(id_col, vector_col), queries.select(query_id, query_vector), _dense_scorer, k, metric, max_shipped_bytes, blocks, limits
    )


def not_compared(
    corpus: DataFrame, queries: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding", query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """``side, id, dimension, status`` of every document and query that no search can compare.

    The status is ``no vector`` (null or empty), or ``no such query`` or ``no such document`` where the other side has
    no vector of that length.
    """

    def sized(df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("id"), F.when(F.col(vector).isNotNull(), F.size(vector)).alias("dimension"))

    docs, asks = sized(corpus, id_col, vector_col), sized(queries, query_id, query_vector)

    def lone(rows: DataFrame, side: str, others: DataFrame, missing: str) -> DataFrame:
        # One row per length.
        known = F.broadcast(others.where("dimension > 0").select("dimension").distinct())
        status = F.when(F.col("dimension") > 0, missing).otherwise("no vector")
        return rows.join(known, "dimension", "left_anti").select(F.lit(side).alias("side"), "id", "dimension", status.alias("status"))

    return lone(docs, "document", asks, "no such query").unionAll(lone(asks, "query", docs, "no such document"))


def nearest_terms(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "doc_id",
    terms_col: str = "terms",
    query_id: str = "query_id",
    query_terms: str = "terms",
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
    blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """The same by cosine for sparse unit vectors with buckets of any range.

    Vectors are ``array<struct<bucket,weight>>``. A task keeps only the columns
    that occur in its queries: documents are never made dense, and no bucket,
    however common, becomes a join key. A row without a shared bucket is no hit.
    """
    found = _search(
        corpus.select(id_col, terms_col), queries.select(query_id, query_terms), _sparse_scorer, k, "dot", max_shipped_bytes, blocks
    )
    return found.filter(F.col("score") > 0)


def _search(
    corpus: DataFrame, queries: DataFrame, scorer: Scorer, k: int, metric: str, max_shipped_bytes: int,
    blocks: tuple[int, int] | None, limits: tuple[float, float] = EVERY_SCORE,
) -> DataFrame:
    vector = queries.columns[1]
    widest = queries.agg(F.max(F.size(vector))).head()[0]
    row_bytes = 8 * max(1, widest or 1) * (1 if scorer is _dense_scorer else 2)
    fit = max(1, min(MAX_SHIPPED_QUERIES, max_shipped_bytes // row_bytes))
    if blocks is None:
        asked = queries.limit(fit + 1).toArrow()
        if asked.num_rows <= fit:
            found = _candidates(corpus, asked, _id_type(queries), scorer, k, metric, limits)
            return _ranked(found, k, metric)
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    blocks = _block_counts(corpus.count(), queries.count(), row_bytes, cores, blocks or (1, 1))
    found = _block_candidates(corpus, queries, scorer, k, metric, blocks, limits)
    return _ranked(found, k, metric)


def score_summary(
    corpus: DataFrame, queries: DataFrame, limits: tuple[float, float], id_col: str = "doc_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, hits, nearest, farthest`` over all rows whose squared distance lies within the limits.

    Every row is counted, whatever the number of hits; each task sends one row per query. The queries
    (``query_id``, ``embedding``) travel with the tasks and must be few enough for that.
    """
    asked = queries.select("query_id", "embedding")
    width = asked.agg(F.max(F.size("embedding"))).head()[0] or 1
    table = asked.limit(MAX_SHIPPED_BYTES // (8 * width) + 1).toArrow()
    if table.num_rows * 8 * width > MAX_SHIPPED_BYTES:
        raise ValueError("too many queries for one summary; ask for them in parts")
    own = [(dim, rows.column(0).to_pylist(), _one_chunk(rows.column(1))) for dim, rows in _by_dimension(table, _dense_scorer)]
    ids = [query_id for _, names, _ in own for query_id in names]
    schema = pa.schema([("query_id", _ARROW_IDS[_id_type(asked)]), ("hits", pa.int64()), ("nearest", pa.float64()), ("farthest", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, low, high = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        wanted, start = {}, 0
        for dim, names, vectors in own:
            wanted[dim] = list(enumerate(dense_matrix(vectors), start))
            start += len(names)
        for dim, part in ((dim, part) for batch in batches for dim, part in _by_dimension(batch, _dense_scorer)):
            rows = dense_matrix(part.column(1))
            for q, query in wanted.get(dim, ()):
                costs = np.round(((rows - query) ** 2).sum(axis=1), SCORE_DIGITS)
                costs = costs[(costs >= limits[0]) & (costs <= limits[1])]
                if len(costs):
                    hits[q], low[q], high[q] = hits[q] + len(costs), min(low[q], costs.min()), max(high[q], costs.max())
        used = np.flatnonzero(hits)
        columns = [pa.array([ids[q] for q in used], schema.types[0]), pa.array(hits[used]), pa.array(low[used]), pa.array(high[used])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = f"query_id {_id_type(asked)}, hits bigint, nearest double, farthest double"
    parts = corpus.select(id_col, vector_col).mapInArrow(count, ddl)
    return parts.groupBy("query_id").agg(
        F.sum("hits").alias("hits"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest")
    )


def nearest_to_one(
    corpus: DataFrame, vector: Sequence[float], k: int, id_col: str = "doc_id", vector_col: str = "embedding", metric: str = "l2",
    limits: tuple[float, float] = EVERY_SCORE,
) -> DataFrame:
    """``doc_id, score, rank`` of the ``k`` vectors nearest to one given vector, within the limits."""
    narrow = corpus.select(id_col, vector_col)
    asked = pa.table({"query_id": pa.array([0], pa.int32()), "vector": pa.array([list(vector)], pa.list_(pa.float64()))})
    found = _candidates(narrow, asked, "int", _dense_scorer, k, metric, limits)
    return _ranked(found, k, metric).select("doc_id", "score", "rank")


def vector_of(df: DataFrame, key, id_col: str = "doc_id", vector_col: str = "embedding") -> list[float]:
    """The vector stored under one id."""
    return list(df.filter(F.col(id_col) == F.lit(key)).select(vector_col).first()[0])

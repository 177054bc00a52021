"""A stored index of vectors: inverted lists with product-quantized codes, for approximate and exact neighbours.

A coarse quantizer, trained on a bounded sample, sends every vector to the list of its nearest centroid. The lists are a
Parquet table partitioned by ``dim`` and ``cell``; each row has the vector, its distance to the centroid and a short code
of what is left of it (a byte for every few dimensions). A search only reads the lists that some query needs.

Approximate search reads the codes of the nearest lists, ranks by them, and scores the best few of each query exactly.
Exact search first scores the lists next to a query, which bounds its k-th distance; a list whose nearest possible vector
is farther (the distance to the centroid less the radius, by the triangle inequality) is not opened at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.operators.neighbours import (
    _ARROW_IDS, BLOCK_BYTES, EVERY_SCORE, SCORE_DIGITS, _Best, _dense_scorer, _hit_schemas, _id_type, _one_chunk, _ranked, dense_matrix,
)

SAMPLE_ROWS = 50_000  # vectors that the quantizers are trained on, at most about
MOST_CELLS = 1024  # lists of each dimension; about the square root of the rows below that
PART_DIMENSIONS = 4  # dimensions for each byte of a code
CODEWORDS = 256
RESCORED = 100  # rows of each query that are scored exactly
GROUP_ROWS = 1 << 20  # rows whose codes a task holds
GROUP_QUERIES = 64  # queries of a task, if there are enough tasks for that
_ROUNDS = 12
_CHUNK = 8192
_LIST = ["dim", "cell"]

# (centroids, codewords of each part) by dimension
Quantizers = dict[int, tuple[np.ndarray, list[np.ndarray]]]


@dataclass
class VectorIndex:
    """A stored index: its rows (``id, vector, code, row, distance, dim, cell``) and the quantizers."""

    rows: DataFrame
    quantizers: Quantizers
    sizes: dict[tuple[int, int], int]  # rows of each list
    radii: dict[tuple[int, int], float]

    def only(self, cells: set[tuple[int, int]]) -> DataFrame:
        """The rows of some lists; the files of all others are left alone."""
        wanted = F.lit(False)
        for dim in {dim for dim, _ in cells}:
            wanted = wanted | ((F.col("dim") == dim) & F.col("cell").isin([cell for own, cell in cells if own == dim]))
        return self.rows.where(wanted)


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, good for choosing the nearest."""
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None, :]


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = [_distances(rows[n : n + _CHUNK], centres).argmin(axis=1) for n in range(0, len(rows), _CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _centres(rows: np.ndarray, count: int, rng: np.random.Generator, spread: bool = False) -> np.ndarray:
    """k-means; a centre without rows stays where it is. With ``spread`` the first centres are chosen far from each other."""
    if spread:
        centres = _far_rows(rows, min(count, len(rows)), rng)
    else:
        centres = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(_ROUNDS):
        own = _nearest_centre(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _far_rows(rows: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Rows drawn one by one, with odds by the squared distance to the nearest of those before."""
    chosen = [int(rng.integers(len(rows)))]
    cost = np.full(len(rows), np.inf)
    while len(chosen) < count:
        cost = np.minimum(cost, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        total = cost.sum()
        if total == 0:
            break
        chosen.append(int(rng.choice(len(rows), p=cost / total)))
    return rows[chosen].copy()


def _parts(dim: int) -> list[slice]:
    """The dimensions of each part of a code."""
    return [slice(at, at + PART_DIMENSIONS) for at in range(0, dim, PART_DIMENSIONS)]


def _trained(rows: np.ndarray, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(0)
    centres = _centres(rows, max(1, min(MOST_CELLS, round(total**0.5))), rng)
    rest = rows - centres[_nearest_centre(rows, centres)]
    return centres, [_centres(np.ascontiguousarray(rest[:, part]), CODEWORDS, rng) for part in _parts(rows.shape[1])]


def train(vectors: DataFrame, id_col: str, vector_col: str, sample_rows: int = SAMPLE_ROWS) -> Quantizers:
    """Quantizers of each length of vector, from about ``sample_rows`` vectors chosen by a hash of the id and the vector."""
    rows = vectors.select(F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim"), F.xxhash64(id_col, vector_col).alias("h")).where("dim > 0")
    totals = {row["dim"]: row["count"] for row in rows.groupBy("dim").count().collect()}  # a row per length of vector
    share = min(1.0, sample_rows / max(1, sum(totals.values())))
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("dim", "h").limit(2 * sample_rows).toArrow()
    found = {}
    for dim in totals:
        own = sample.filter(pc.equal(sample["dim"], dim))
        # a length that the sample misses has one list, around the origin
        found[dim] = _trained(dense_matrix(_one_chunk(own["vector"])), totals[dim]) if own.num_rows else _trained(np.zeros((1, dim)), 1)
    return found


def _coded(vectors: DataFrame, quantizers: Quantizers, id_type: str, vector_type: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(quantizers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1))
            for dim, (centres, books) in shared.value.items():
                for start in range(0, batch.num_rows, _CHUNK):
                    part = batch.slice(start, _CHUNK).filter(pc.equal(sizes.slice(start, _CHUNK), dim))
                    if not part.num_rows:
                        continue
                    rows = dense_matrix(part.column(1))
                    cell = _nearest_centre(rows, centres)
                    rest = rows - centres[cell]
                    code = [_nearest_centre(rest[:, own], book) for own, book in zip(_parts(dim), books, strict=True)]
                    codes = np.stack(code, axis=1).astype(np.uint8)
                    columns = [
                        *part.columns, pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(np.sqrt((rest**2).sum(axis=1))),
                        pa.array(np.full(len(rows), dim, np.int32)), pa.array(cell.astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "code", "distance", *_LIST])

    return vectors.mapInArrow(work, f"id {id_type}, vector {vector_type}, code binary, distance double, dim int, cell int")


def build_index(vectors: DataFrame, path: str, id_col: str = "doc_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Stores an index of all rows with a vector, of whatever lengths, under ``path``.

    Rows with a null or empty vector are left out, repeated ids are rows of their own. Rows are dealt by list and a hash,
    in ranges of like size, so that a list with very many rows is written by several tasks.
    """
    spark, types = vectors.sparkSession, dict(vectors.dtypes)
    quantizers = train(vectors, id_col, vector_col, sample_rows)
    coded = _coded(vectors.select(id_col, vector_col), quantizers, types[id_col], types[vector_col])
    rows = coded.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*_LIST, F.xxhash64("row")).sortWithinPartitions(*_LIST)
    dealt.write.partitionBy(*_LIST).parquet(f"{path}/lists")
    flat = [
        (dim, part, values.shape[0], values.shape[1], values.ravel().tolist())
        for dim, (centres, books) in quantizers.items() for part, values in enumerate([centres, *books])
    ]
    spark.createDataFrame(flat, "dim int, part int, count int, width int, numbers array<double>").write.parquet(f"{path}/quantizers")
    return open_index(spark, path, types[id_col], types[vector_col])


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", vector_type: str = "array<float>") -> VectorIndex:
    quantizers: Quantizers = {}
    for row in spark.read.parquet(f"{path}/quantizers").orderBy("dim", "part").collect():  # of bounded size
        values = np.array(row["numbers"]).reshape(row["count"], row["width"])
        if row["part"]:
            quantizers[row["dim"]][1].append(values)
        else:
            quantizers[row["dim"]] = (values, [])
    schema = f"id {id_type}, vector {vector_type}, code binary, distance double, row bigint, dim int, cell int"
    rows = spark.read.schema(schema).parquet(f"{path}/lists")
    # a row per list
    lists = rows.groupBy(*_LIST).agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect() if quantizers else []
    sizes = {(row["dim"], row["cell"]): row["n"] for row in lists}
    return VectorIndex(rows, quantizers, sizes, {(row["dim"], row["cell"]): row["radius"] for row in lists})


# From the distances of some queries to the centroids of the lists, whether each query needs each list.
Choice = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _nearest_lists(count: int) -> Choice:
    def choose(distances, sizes, radii, bounds):
        return distances.argsort(axis=1, kind="stable").argsort(axis=1) < count

    return choose


def _first_lists(k: int) -> Choice:
    """The nearest lists until they have ``k`` rows."""

    def choose(distances, sizes, radii, bounds):
        order = distances.argsort(axis=1, kind="stable")
        before = sizes[order].cumsum(axis=1) - sizes[order]
        return np.take_along_axis(before < k, order.argsort(axis=1), axis=1)

    return choose


def _near_lists(distances, sizes, radii, bounds):
    """The lists that can have a vector within the bound of the query."""
    least = np.maximum(np.sqrt(np.maximum(distances, 0)) - radii, 0) ** 2
    return least <= (bounds + 1e-9 * (1 + np.where(np.isinf(bounds), 0, bounds)))[:, None]


def _probes(index: VectorIndex, asked: DataFrame, choose: Choice) -> DataFrame:
    """``query_id, query, dim, cell`` of the lists that each query needs; ``asked`` has ``query_id``, ``query`` and ``bound``."""
    held = {}
    for dim, (centres, _) in index.quantizers.items():
        own = np.array([cell for cell in range(len(centres)) if (dim, cell) in index.sizes], np.int64)
        if len(own):
            held[dim] = (own, centres[own], np.array([index.sizes[dim, c] for c in own]), np.array([index.radii[dim, c] for c in own]))
    shared = asked.sparkSession.sparkContext.broadcast(held)
    types = dict(asked.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1))
            for dim, (own, centres, rows, radii) in shared.value.items():
                part = batch.filter(pc.equal(sizes, dim))
                for start in range(0, part.num_rows, 256):
                    few = part.slice(start, 256)
                    distances = _distances(dense_matrix(few.column(1)), centres)
                    query, at = np.nonzero(choose(distances, rows, radii, few.column(2).to_numpy(zero_copy_only=False)))
                    taken = few.take(pa.array(query))
                    places = [pa.array(np.full(len(at), dim, np.int32)), pa.array(own[at].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *places], names=["query_id", "query", *_LIST])

    return asked.mapInArrow(work, f"query_id {types['query_id']}, query {types['query']}, dim int, cell int")


def _queries_of(probes: DataFrame) -> dict[tuple[int, int], int]:
    """How many queries need each list: a row per list that some query needs."""
    return {(row["dim"], row["cell"]): row["count"] for row in probes.groupBy(*_LIST).count().collect()}


def _met(
    index: VectorIndex, probes: DataFrame, counts: dict[tuple[int, int], int], columns: list[str], row_bytes: int, work, ddl: str
) -> DataFrame:
    """``work(rows, queries)`` for every list and the queries that need it; both are cut into blocks of bounded size.

    Only the probed lists and the named columns are read.
    """
    per_block = max(1, BLOCK_BYTES // row_bytes)
    cuts = [(d, c, -(-index.sizes[d, c] // per_block), -(-n * 8 * d // BLOCK_BYTES)) for (d, c), n in counts.items()]
    spark = probes.sparkSession
    table = F.broadcast(spark.createDataFrame(cuts, "dim int, cell int, blocks int, query_blocks int"))

    def spread(rows: DataFrame, key: str, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        dealt = rows.join(table, _LIST)
        place = F.pmod(F.xxhash64(key), F.col(own_count)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col(other_count) - 1))
        return dealt.select(*rows.columns, place.alias(own), others.alias(other))

    rows = spread(index.only(set(counts)).select(*columns, *_LIST), columns[0], "block", "blocks", "query_block", "query_blocks")
    asks = spread(probes, "query_id", "query_block", "query_blocks", "block", "blocks")
    keys = [*_LIST, "block", "query_block"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(work, ddl)


def _met_in_groups(index: VectorIndex, probes: DataFrame, counts: dict[tuple[int, int], int], work, ddl: str) -> DataFrame:
    """As ``_met`` for codes, but with many small lists, or a part of a large one, in each task.

    So a query gets its best rows from a task and not from each list.
    """
    places, group, held, of = [], -1, 0, None
    for (dim, cell), size in sorted((key, index.sizes[key]) for key in counts):
        cuts = -(-size // GROUP_ROWS)
        if dim != of or held + size > GROUP_ROWS:
            group, held = group + 1, 0
        places.append((dim, cell, group, cuts))
        group, held, of = group + cuts - 1, held + size if cuts == 1 else GROUP_ROWS, dim
    spark = probes.sparkSession
    asked = probes.select("query_id").distinct().count()
    widest = max((dim for dim, _ in counts), default=1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, min(-(-asked // GROUP_QUERIES), tasks), -(-asked * 8 * widest // BLOCK_BYTES))
    # a row per list
    table = F.broadcast(spark.createDataFrame(places, "dim int, cell int, first int, cuts int"))
    rows = index.only(set(counts)).select("row", "code", *_LIST).join(table, _LIST)
    rows = rows.select(
        "row", "code", "cell", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("cuts"))).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    block = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    asks = probes.join(table, _LIST).select(
        "query_id", "query", *_LIST, F.explode(F.sequence("first", F.col("first") + F.col("cuts") - 1)).alias("group"), block.alias("query_block")
    )
    keys = ["group", "query_block"]
    return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(work, ddl)


def _asked(queries: DataFrame, query_id: str, query_vector: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("query"), F.lit(float("inf")).alias("bound"))


def _scored(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of every probed block to each of its queries, by exact distances."""
    ddl, schema = _hit_schemas(_id_type(probes), _id_type(index.rows))

    def work(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return schema.empty_table()
        best = _Best(_one_chunk(asks["query_id"]), _one_chunk(asks["query"]), _dense_scorer, k, "l2", EVERY_SCORE, schema.types[1])
        for batch in rows.to_batches():
            best.add(batch["id"], batch["vector"])
        return pa.Table.from_batches([best.batch(schema)])

    widest = max((dim for dim, _ in index.sizes), default=1)
    return _met(index, probes, _queries_of(probes), ["id", "vector"], 8 * widest, work, ddl)


def nearest_in_index(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """``query_id, doc_id, score, rank`` as ``nearest`` by squared distance, without the lists that are too far from every query."""
    asked = _asked(queries, query_id, query_vector)
    first = _ranked(_scored(index, _probes(index, asked, _first_lists(k)), k), k, "l2")
    bounds = first.groupBy(F.col("query_id").alias("of")).agg(F.when(F.count("*") >= k, F.max("score")).alias("known"))
    bounded = asked.join(bounds, F.col("query_id").eqNullSafe(F.col("of")), "left")
    bounded = bounded.select("query_id", "query", F.coalesce("known", "bound").alias("bound"))
    return _ranked(_scored(index, _probes(index, bounded, _near_lists), k), k, "l2")


def approximate_in_index(
    index: VectorIndex, queries: DataFrame, k: int, probes: int = MOST_CELLS, rescored: int = RESCORED, query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` nearest of the ``rescored`` rows that the codes of ``probes`` lists find nearest.

    The scores are exact. A neighbour in a list that is not probed, or behind ``rescored`` others by its code, is missed.
    Vectors without clusters need many lists; their codes are a sixteenth of the vectors, and no others are scored exactly.
    """
    asked = _asked(queries, query_id, query_vector)
    probed = _probes(index, asked, _nearest_lists(probes))
    kind = dict(asked.dtypes)["query_id"]
    shared = asked.sparkSession.sparkContext.broadcast(index.quantizers)
    out = pa.schema([("query_id", _ARROW_IDS[kind]), ("doc_id", pa.int64()), ("score", pa.float64()), *[(n, pa.int32()) for n in _LIST]])

    def work(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return out.empty_table()
        dim = asks["dim"][0].as_py()
        centres, books = shared.value[dim]
        rows = rows.sort_by("cell")
        cells, own = rows["cell"].to_numpy(), rows["row"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        near: dict = {}
        for query_id, cell, query in zip(asks["query_id"].to_pylist(), asks["cell"].to_pylist(), dense_matrix(_one_chunk(asks["query"])), strict=True):
            begin, end = np.searchsorted(cells, [cell, cell + 1])
            rough, rest = np.zeros(end - begin), query - centres[cell]
            for n, part in enumerate(_parts(dim)):
                rough += ((books[n] - rest[part]) ** 2).sum(axis=1)[codes[begin:end, n]]
            near.setdefault(query_id, []).append((np.arange(begin, end), rough))
        names, found = [], []
        for parts in near.values():
            at, rough = (np.concatenate(column) for column in zip(*parts, strict=True))
            best = np.argpartition(rough, rescored - 1)[:rescored] if len(rough) > rescored else np.arange(len(rough))
            names.append(at[best])
            found.append(rough[best])
        at = np.concatenate(names)
        each = [query_id for query_id, own_names in zip(near, names, strict=True) for _ in own_names]
        columns = [each, own[at], np.concatenate(found), np.full(len(at), dim, np.int32), cells[at]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    counts = _queries_of(probed)
    rough = _met_in_groups(index, probed, counts, work, f"query_id {kind}, doc_id bigint, score double, dim int, cell int")
    few = _ranked(rough, rescored, "l2").select("query_id", F.col("doc_id").alias("row"), *_LIST)
    vectors = index.only(set(counts)).select("id", "vector", "row", *_LIST)
    asked = asked.select(F.col("query_id").alias("of"), "query")
    both = few.join(vectors, [*_LIST, "row"]).join(asked, F.col("query_id").eqNullSafe(F.col("of")))
    squares = F.zip_with("vector", "query", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    score = F.round(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x), SCORE_DIGITS)
    return _ranked(both.select("query_id", F.col("id").alias("doc_id"), score.alias("score")), k, "l2")

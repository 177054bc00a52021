"""All-pairs cosine similarity inside a table or inside each of its groups.

Pairs are never rows. Counts, means and deviations come from one scan: the similarities of unit vectors add up to a
function of their sum, and the squared similarities to one of their Gram matrix. For the extremes, vectors are put into
blocks around centres. Two blocks are compared in one task, and only if the angle between their centres and their radii
leave room for a pair that is more extreme than those found inside the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from docsift.operators.neighbours import BLOCK_BYTES, SCORE_DIGITS, _one_chunk, _units, dense_matrix
from docsift.operators.vector_index import _centres
from docsift.session import written

BLOCK_ROWS = 2048  # a block is not made smaller than this for the sake of more tasks
MAX_CENTRES = 1024
FINER = 4
SAMPLE_ROWS = 20_000  # vectors that the centres are trained on, at most about
MAX_BROADCAST_GROUPS = 100_000
_STRIP_VALUES = 1_000_000
_ROUNDING = 10.0**-SCORE_DIGITS
_GRAM_VALUES = 4_000_000  # numbers of all Gram matrices that a task holds before it sends them on
_WHOLE, _ZERO = -1, -2  # cells of groups that fit one block, and of vectors without a direction
_ROOM = 1e-6  # radians; more than the error of an angle

_CELL_DDL = "label string, lo bigint, hi bigint, n bigint, low double, high double, pairs array<struct<i:bigint,j:bigint,sim:double>>"
_PAIRS = pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64())]))
_CELL_ARROW = pa.schema(
    [("label", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("low", pa.float64()),
     ("high", pa.float64()), ("pairs", _PAIRS)]
)


def _cell_summary(
    ids: np.ndarray, rows: np.ndarray, other_ids: np.ndarray, other: np.ndarray, same: bool, keep: int, most: float, least: float
):
    """Count and outermost pairs of two blocks, or of one block with itself.

    ``keep`` pairs of at least ``most`` and of at most ``least`` are known already. Only similarities that reach
    these bounds, which rise with the pairs found here, are looked at one by one.
    """
    if same:
        copies = np.unique(ids, return_counts=True)[1]
        n = (len(ids) * (len(ids) - 1) - int((copies * (copies - 1)).sum())) // 2
    else:
        n = len(ids) * len(other_ids)
    best = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
    strip = max(1, _STRIP_VALUES // max(1, len(other)))
    for start in range(0, len(rows), strip):
        sims = rows[start : start + strip] @ other.T
        left, right = np.nonzero((sims >= most - _ROUNDING) | (sims <= least + _ROUNDING))
        values = np.round(sims[left, right], SCORE_DIGITS) + 0.0
        a, b = ids[start + left], other_ids[right]
        if same:
            upper = a < b
            a, b, values = a[upper], b[upper], values[upper]
        if not len(values):
            continue
        part = len(values)
        high = np.partition(values, max(0, part - keep))[max(0, part - keep)]
        low = np.partition(values, min(part, keep) - 1)[min(part, keep) - 1]
        for picked in (values > high, values == high, values < low, values == low):
            pairs = np.minimum(a[picked], b[picked]), np.maximum(a[picked], b[picked]), values[picked]
            first = _smallest_pairs(pairs[0], pairs[1], keep)
            best = [np.concatenate([old, new[first]]) for old, new in zip(best, pairs)]
        best = _outermost(*best, keep)
        if len(best[2]) >= keep:
            most = max(most, np.partition(best[2], len(best[2]) - keep)[len(best[2]) - keep])
            least = min(least, np.partition(best[2], keep - 1)[keep - 1])
    return n, best


def _smallest_pairs(i: np.ndarray, j: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` pairs by (i, j), and maybe a few more, in linear time.

    Very many pairs tie where many vectors are equal.
    """
    if len(i) <= 4 * keep:
        return np.arange(len(i))
    bound = np.partition(i, keep - 1)[keep - 1]
    at = np.flatnonzero(i == bound)
    if len(at) > keep:
        at = at[np.argpartition(j[at], keep - 1)[:keep]]
    return np.concatenate([np.flatnonzero(i < bound), at])


def _outermost(i: np.ndarray, j: np.ndarray, sim: np.ndarray, keep: int) -> list[np.ndarray]:
    # A pair may have come in twice, as one of the highest and of the lowest.
    _, once = np.unique(np.stack([i, j]), axis=1, return_index=True)
    i, j, sim = i[once], j[once], sim[once]
    chosen = np.union1d(np.lexsort((j, i, -sim))[:keep], np.lexsort((j, i, sim))[:keep])
    return [i[chosen], j[chosen], sim[chosen]]


def _rows(vectors: DataFrame, id_col: str, vector_col: str, group: Column | None) -> DataFrame:
    label = F.lit("") if group is None else group.cast("string")
    rows = vectors.select(
        label.alias("label"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")
    )
    return rows.filter(F.col("label").isNotNull() & (F.size("vector") > 0))


def _moments(rows: DataFrame) -> DataFrame:
    """``label, pairs, mean_similarity, std_similarity``, without any pair.

    With S the sum of a group's unit vectors and G their Gram matrix by dimension, the similarities of all ordered pairs,
    each vector with itself included, add up to |S|^2 and their squares to the sum of the squared entries of G.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        dim = 0

        def sent() -> pa.RecordBatch:
            values = pa.array(list(held.values()), pa.list_(pa.float64()))
            dims = pa.array(np.full(len(held), dim, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), dims, values], names=["label", "dim", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            unit, coded = _units(dense_matrix(batch.column(1))), batch.column(0).dictionary_encode()
            codes, dim = coded.indices.to_numpy(), unit.shape[1]
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            for label, start, end in zip(coded.dictionary.to_pylist(), bounds, bounds[1:]):
                own = unit[order[start:end]]
                squares = (own**2).sum(axis=1)
                found = np.concatenate([[len(own), squares.sum(), (squares**2).sum()], own.sum(axis=0), (own.T @ own).ravel()])
                held[label] = held[label] + found if label in held else found
                if len(held) * len(found) > _GRAM_VALUES:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    places = (
        rows.select("label", "vector")
        .mapInArrow(sums, "label string, dim int, sums array<double>")
        .select("label", "dim", F.posexplode("sums").alias("place", "value"))
        .groupBy("label", "dim", "place")
        .agg(F.sum("value").alias("value"))
    )
    square, place = F.col("value") * F.col("value"), F.col("place")
    totals = places.groupBy("label").agg(
        *[F.max(F.when(place == at, F.col("value"))).alias(name) for at, name in enumerate(("n", "own", "own_squares"))],
        F.sum(F.when((place >= 3) & (place < F.col("dim") + 3), square)).alias("all"),
        F.sum(F.when(place >= F.col("dim") + 3, square)).alias("all_squares"),
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean, squares = (F.col("all") - F.col("own")) / 2 / pairs, (F.col("all_squares") - F.col("own_squares")) / 2 / pairs
    return totals.filter(F.col("n") > 1).select(
        "label",
        pairs.cast("bigint").alias("pairs"),
        mean.alias("mean_similarity"),
        F.sqrt(F.greatest(F.lit(0.0), squares - mean * mean)).alias("std_similarity"),
    )


def _trained_centres(rows: DataFrame, total: int, count: int) -> np.ndarray:
    """Directions that the blocks lie around: about ``count`` of them, or more where the vectors lie in clusters.

    Finer blocks leave out more pairs, but copy vectors more often if they have to be compared all the same.
    """
    hashed = rows.select("vector", F.xxhash64("label", "id", "vector").alias("h"))
    share = min(1.0, SAMPLE_ROWS / total)
    sample = hashed.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("h").limit(2 * SAMPLE_ROWS).toArrow()
    unit = _units(dense_matrix(_one_chunk(sample["vector"])))
    for wanted in (FINER * count, count):
        centres = _units(_centres(unit, min(MAX_CENTRES, wanted), np.random.default_rng(0), spread=True))
        centres[(centres == 0).all(axis=1), 0] = 1.0
        if _apart(unit, centres) > 0.5:
            break
    return centres


def _apart(unit: np.ndarray, centres: np.ndarray) -> float:
    """The share of pairs of centres whose vectors do not reach each other."""
    near = unit @ centres.T
    own, radii = near.argmax(axis=1), np.zeros(len(centres))
    np.maximum.at(radii, own, np.arccos(np.clip(near[np.arange(len(unit)), own], -1, 1)))
    gaps = np.arccos(np.clip(centres @ centres.T, -1, 1))
    return float((gaps > radii[:, None] + radii[None, :]).mean())


def _placed(rows: DataFrame, block_rows: int | None) -> tuple[DataFrame, np.ndarray | None]:
    """``label, id, vector, cell, angle, block`` and the centres; without centres every group is one block.

    Blocks have at most about ``block_rows`` rows. By default that is as many as fit ``BLOCK_BYTES``, or fewer where that
    would leave cores idle, so that a vector is not copied to more tasks than needed.
    """
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
    size = counts.agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.max("dim").alias("dim"), F.count("*").alias("labels")).head()
    total, largest = size["n"] or 0, size["largest"] or 0
    if block_rows is None:
        busy = math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))
        most = max(1, BLOCK_BYTES // (8 * (size["dim"] or 1)))
        block_rows = min(most, max(BLOCK_ROWS, math.ceil(total / busy)))
    if largest <= block_rows:
        return rows.withColumns({"cell": F.lit(_WHOLE), "angle": F.lit(0.0), "block": F.lit(0).cast("bigint")}), None
    centres = _trained_centres(rows, total, math.ceil(total / block_rows))
    groups = counts.select("label", (F.col("n") > block_rows).alias("split"))
    sized = rows.join(F.broadcast(groups) if size["labels"] <= MAX_BROADCAST_GROUPS else groups, "label")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(dense_matrix(batch.column(2)))
            near = unit @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(unit)), cell], -1, 1))
            cell = np.where((unit == 0).all(axis=1), _ZERO, cell)
            cell = np.where(batch.column(3).to_numpy(zero_copy_only=False), cell, _WHOLE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(angle)], names=["label", "id", "vector", "cell", "angle"])

    kind = rows.schema["vector"].dataType.simpleString()
    ddl = f"label string, id bigint, vector {kind}, cell int, angle double"
    near = sized.select("label", "id", "vector", "split").mapInArrow(nearest, ddl)
    # Numbered by row, so that copies of an id spread over the blocks of a cell.
    near = written(near.withColumn("row", F.monotonically_increasing_id()), "pair-cells")
    lists = near.groupBy("label", "cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    blocks = near.join(lists, ["label", "cell"]).withColumn("block", (F.col("cell") + 2) * F.lit(1 << 32) + part)
    return blocks.select("label", "id", "vector", "cell", "angle", "block"), centres


def _bounded(placed: DataFrame, centres: np.ndarray) -> DataFrame:
    """All pairs of blocks of a group: ``label, lo, hi, n, upper, lower``, the last two bound their similarities."""
    blocks = placed.groupBy("label", "block", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    blocks = written(blocks, "pair-blocks")
    angles = np.arccos(np.clip(centres @ centres.T, -1, 1))

    @F.pandas_udf("double")
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(angles[np.maximum(a, 0), np.maximum(b, 0)])

    a = blocks.select("label", *[F.col(name).alias(f"a_{name}") for name in ("block", "cell", "n", "radius")])
    b = blocks.select("label", *[F.col(name).alias(f"b_{name}") for name in ("block", "cell", "n", "radius")])
    both = a.join(b, "label").filter(F.col("a_block") <= F.col("b_block")).withColumn("gap", gap("a_cell", "b_cell"))
    reach = F.col("a_radius") + F.col("b_radius") + _ROOM
    zero = (F.col("a_cell") == _ZERO) | (F.col("b_cell") == _ZERO)
    nearest, farthest = F.greatest(F.lit(0.0), F.col("gap") - reach), F.least(F.lit(math.pi), F.col("gap") + reach)
    same = F.col("a_block") == F.col("b_block")
    n = F.when(same, F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))
    return both.select(
        "label", F.col("a_block").alias("lo"), F.col("b_block").alias("hi"), n.alias("n"),
        F.when(zero, 0.0).otherwise(F.cos(nearest)).alias("upper"), F.when(zero, 0.0).otherwise(F.cos(farthest)).alias("lower"),
    )


def _compared(placed: DataFrame, pairs: DataFrame | None, keep: int) -> DataFrame:
    """Count and outermost pairs of each pair of blocks; of every block with itself where ``pairs`` is None.

    ``pairs`` has the bounds known for its group in ``most`` and ``least``, or nulls.
    """
    known = ["most", "least"]
    if pairs is None:
        own = F.col("block")
        cells = placed.select("label", "id", "vector", own.alias("own"), own.alias("lo"), own.alias("hi"), *[F.lit(None).cast("double").alias(name) for name in known])
    else:
        sides = pairs.select("label", F.col("lo").alias("own"), "lo", "hi", *known).union(
            pairs.filter("lo < hi").select("label", F.col("hi").alias("own"), "lo", "hi", *known)
        )
        cells = placed.withColumnRenamed("block", "own").join(sides, ["label", "own"]).select("label", "id", "vector", "own", "lo", "hi", *known)

    def summarize(cell: pa.Table) -> pa.Table:
        own_block = cell["own"].to_numpy()
        ids, unit = cell["id"].to_numpy(), _units(dense_matrix(_one_chunk(cell["vector"])))
        lo, hi = cell["lo"][0].as_py(), cell["hi"][0].as_py()
        left, right = own_block == lo, own_block == hi
        most, least = cell["most"][0].as_py(), cell["least"][0].as_py()
        bounds = -np.inf if most is None else most, np.inf if least is None else least
        n, best = _cell_summary(ids[left], unit[left], ids[right], unit[right], lo == hi, keep, *bounds)
        pairs = [{"i": i, "j": j, "sim": sim} for i, j, sim in zip(*(part.tolist() for part in best))]
        low, high = (float(best[2].min()), float(best[2].max())) if pairs else (None, None)
        row = [cell["label"][0].as_py(), lo, hi, n, low, high, pairs]
        return pa.Table.from_arrays([pa.array([value], kind) for value, kind in zip(row, _CELL_ARROW.types)], schema=_CELL_ARROW)

    return cells.groupBy("label", "lo", "hi").applyInArrow(summarize, _CELL_DDL)


def _extreme_blocks(rows: DataFrame, keep: int, block_rows: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The results of all pairs of blocks that can hold one of the ``keep`` outermost pairs of their group, and all pairs
    of blocks with their bounds.

    Every block is compared with itself and with the block that may be most opposite to it first. The pairs found there
    are bounds that most other pairs of blocks cannot reach, if the vectors lie in clusters.
    """
    placed, centres = _placed(rows, block_rows)
    if centres is None:
        return _compared(placed, None, keep).filter("n > 0"), None
    plan = written(_bounded(placed, centres), "pair-plan")
    opposite = plan.groupBy("label", "lo").agg(F.min_by("hi", F.struct("lower", "hi")).alias("hi"))
    back = plan.groupBy("label", "hi").agg(F.min_by("lo", F.struct("lower", "lo")).alias("lo"))
    itself = plan.filter("lo = hi").select("label", "lo", "hi")
    first = itself.unionByName(opposite).unionByName(back).distinct()
    unknown = {name: F.lit(None).cast("double") for name in ("most", "least")}
    seeds = written(_compared(placed, written(first.withColumns(unknown), "pair-first"), keep), "pair-seeds")
    found = seeds.select("label", F.inline("pairs"))
    most = F.row_number().over(Window.partitionBy("label").orderBy(F.col("sim").desc()))
    least = F.row_number().over(Window.partitionBy("label").orderBy("sim"))
    highest = found.withColumn("at", most).filter(F.col("at") == keep).select("label", F.col("sim").alias("most"))
    lowest = found.withColumn("at", least).filter(F.col("at") == keep).select("label", F.col("sim").alias("least"))
    open_pairs = plan.join(seeds.select("label", "lo", "hi"), ["label", "lo", "hi"], "left_anti")
    open_pairs = open_pairs.join(highest, "label", "left").join(lowest, "label", "left")
    above = F.coalesce(F.col("upper") >= F.col("most") - _ROOM, F.lit(True))
    below = F.coalesce(F.col("lower") <= F.col("least") + _ROOM, F.lit(True))
    rest = written(open_pairs.filter(above | below).select("label", "lo", "hi", "most", "least"), "pair-rest")
    cells = written(seeds.unionByName(_compared(placed, rest, keep)), "pair-results")
    return cells.filter("n > 0"), plan


def compared_share(vectors: DataFrame, id_col: str, vector_col: str, keep: int = 3, block_rows: int | None = None) -> DataFrame:
    """One row ``pairs, compared``: the pairs there are, and those that :func:`outermost_pairs` scores."""
    cells, plan = _extreme_blocks(_rows(vectors, id_col, vector_col, None), keep, block_rows)
    scored = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    pairs = (cells if plan is None else plan).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return pairs.join(scored, how="full")


def similarity_summary(
    vectors: DataFrame, id_col: str, vector_col: str, group: Column | None = None, block_rows: int | None = None
) -> DataFrame:
    """Pairs, mean, population deviation, least and greatest similarity per group.

    Vectors are of one length and ids unique within a group; null and empty vectors and null groups are left out, a
    vector of zeros has similarity 0 to all others.
    """
    rows = _rows(vectors, id_col, vector_col, group)
    cells, _ = _extreme_blocks(rows, 1, block_rows)
    ends = cells.groupBy("label").agg(F.min("low").alias("min_similarity"), F.max("high").alias("max_similarity"))
    out = _moments(rows).join(ends, "label")
    return out if group is not None else out.drop("label")


def outermost_pairs(vectors: DataFrame, id_col: str, vector_col: str, keep: int = 3, block_rows: int | None = None) -> DataFrame:
    """The ``keep`` most and least similar pairs: ``side, position, i, j, sim``; equal ones in order of ``i, j``."""
    cells, _ = _extreme_blocks(_rows(vectors, id_col, vector_col, None), keep, block_rows)
    pairs = cells.select(F.inline("pairs"))

    def end(side: str, sim: Column) -> DataFrame:
        first = pairs.orderBy(sim, "i", "j").limit(keep)  # every task sends its own first few
        position = F.row_number().over(Window.partitionBy("side").orderBy(sim, "i", "j")).cast("bigint")
        return first.withColumn("side", F.lit(side)).select("side", position.alias("position"), "i", "j", "sim")

    return end("most", F.col("sim").desc()).unionByName(end("least", F.col("sim").asc()))


def mean_similarity_by(vectors: DataFrame, group: str, vector_col: str) -> DataFrame:
    """Vectors, dimension and mean pair similarity of each group, without any pair.

    The similarities of all pairs of unit vectors add up to half of the squared
    length of their sum less their number, so one sum vector per group is
    enough; sums are taken per Arrow batch before they are shuffled. Zero
    vectors have similarity 0 to every other vector.
    """
    kind = vectors.schema[group].dataType.simpleString()
    ddl = f"label {kind}, vectors bigint, own double, total array<double>"

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            unit = _units(dense_matrix(batch.column(1)))
            coded = batch.column(0).dictionary_encode()
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            starts = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary)))
            totals = np.add.reduceat(unit[order], starts, axis=0)
            own = np.add.reduceat((unit[order] ** 2).sum(axis=1), starts)
            counts = np.diff(np.append(starts, len(order)))
            columns = [coded.dictionary, pa.array(counts, pa.int64()), pa.array(own), pa.array(list(totals), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "vectors", "own", "total"])

    sums = vectors.filter(F.col(group).isNotNull()).select(group, vector_col).mapInArrow(batch_sums, ddl)
    by_place = (
        sums.select("label", "vectors", "own", F.posexplode("total").alias("place", "value"))
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"), F.sum("vectors").alias("vectors"), F.sum("own").alias("own"))
    )
    groups = by_place.groupBy("label").agg(
        F.max("vectors").alias("vectors"),
        F.count("*").alias("dimension"),
        F.sum(F.col("value") * F.col("value")).alias("__sum"),
        F.max("own").alias("__own"),
    )
    pairs = F.col("vectors") * (F.col("vectors") - 1) / 2
    mean = F.when(pairs > 0, (F.col("__sum") - F.col("__own")) / 2 / F.when(pairs > 0, pairs))
    return groups.select(F.col("label").alias(group), "vectors", "dimension", mean.alias("mean_similarity"))

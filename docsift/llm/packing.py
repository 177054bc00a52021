"""Packing of token sequences into rows of a fixed capacity, by reduction and best fit.

1. Every text is encoded in the tasks and cut into pieces of at most ``capacity`` tokens.
2. The counts of pieces by length are the whole instance: at most ``capacity`` numbers, whatever the input.
3. On these counts, sets that dominate every other way to pack their longest piece are fixed for good
   (Martello and Toth's reduction); the rest is packed by best fit in decreasing length. The result is a list of
   patterns: lengths that share a sequence, and how many sequences there are of this kind.
4. The n-th piece of a length, counted by task and by place in the task, takes the n-th place for that length.
   No group of pieces is ever brought together, so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from docsift.llm.common import batch_of, chunks, shipped, stored
from docsift.llm.word_bpe import WordCodec, WordModel

CAPACITY, END_ID = 2048, 0


def packed(
    docs: DataFrame, id_column: str, text_column: str, tokenizer_path: str,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc``, ``piece`` (from 0), ``start`` (tokens of the document before it),
    ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), ``sequence_id``, ``offset``,
    and ``ids`` if asked for. Only documents longer than the capacity are cut. A sequence has no gaps.

    Null and empty texts are the end id alone. Repeated rows are packed each on their own, null ids too. An empty
    table gives no rows. Other columns are not read.
    """
    pieces = stored(cut_pieces(docs, id_column, text_column, tokenizer_path, capacity, end_id, with_ids), "pieces")
    return placed(pieces, capacity)


def cut_pieces(
    docs: DataFrame, id_column: str, text_column: str, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool
) -> DataFrame:
    """The pieces, with the task that made them (``part``) and their number in it among those of their length (``nth``)."""
    model = shipped(docs.sparkSession, WordModel(tokenizer_path))
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text"))
    more = [pa.field("ids", pa.list_(pa.int32()))] if with_ids else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = WordCodec(model(), end_id), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            schema = pa.schema([
                batch.schema.field(0), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), *more,
            ])
            for begin, end in chunks(texts):
                ids, sizes = codec.encode(texts[begin:end])
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(begin, end), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(np.repeat(sizes, count) - start, capacity)
                bounds = np.concatenate([[0], np.cumsum(length)]).tolist()
                raw = np.ascontiguousarray(ids, "<i4")
                spans = list(zip(bounds, bounds[1:], strict=False))
                crc = [zlib.crc32(raw[a:b]) for a, b in spans]
                nth = seen[length] + _number_in_group(length)
                np.add.at(seen, length, 1)
                columns = [batch.column(0).take(pa.array(doc)), piece, start, length, crc, np.full(len(doc), part), nth]
                yield batch_of(schema, columns + ([[raw[a:b] for a, b in spans]] if with_ids else []))

    kind = dict(rows.dtypes)["doc"]
    schema = f"doc {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return rows.mapInArrow(work, schema + (", ids array<int>" if with_ids else ""))


def _number_in_group(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first
    return out


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[row["length"]] = row["n"]
    places = shipped(pieces.sparkSession, Places(pack_counts(histogram)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before"))
    names = [c for c in pieces.columns if c not in ("part", "nth", "ids")]
    more = ["ids"] if "ids" in pieces.columns else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = places()
        for batch in batches:
            sequence, offset = found.find(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)] + [batch.column(n) for n in more]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset", *more])

    types = dict(pieces.dtypes) | {"sequence_id": "long", "offset": "long"}
    schema = ", ".join(f"{n} {types[n]}" for n in [*names, "sequence_id", "offset", *more])
    return numbered.select(*names, "nth", *more).mapInArrow(work, schema)


class Places:
    """For each length the places of the patterns in order, found by the number of a piece among those of its length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        used: Counter[int] = Counter()
        runs, base = [], 0
        for lengths, count in patterns:
            offset = 0
            for length in lengths:
                runs.append((length, used[length], base, offset))
                used[length] += count
                offset += length
            base += count
        runs.sort()
        self.keys = np.array([length << 48 | first for length, first, _, _ in runs], np.int64)
        self.first = np.array([first for _, first, _, _ in runs], np.int64)
        self.base = np.array([base for _, _, base, _ in runs], np.int64)
        self.offset = np.array([offset for _, _, _, offset in runs], np.int64)

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.keys, length << 48 | nth, "right") - 1
        return self.base[run] + nth - self.first[run], self.offset[run]


def pack_counts(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that pack ``histogram[length]`` pieces of each length; the capacity is its last index."""
    left = histogram.copy()
    fixed = reduced(left)
    return fixed + best_fit(left)


def reduced(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets and takes them out of ``left``, until no rule fits any length."""
    out, changed = [], True
    while changed:
        changed = False
        for j in range(len(left) - 1, 0, -1):
            while left[j] and (found := _dominating(left, j)):
                times = min(left[x] // n for x, n in Counter(found).items())
                for x, n in Counter(found).items():
                    left[x] -= n * times
                out.append((found, int(times)))
                changed = True
    return out


def _dominating(left: np.ndarray, j: int) -> tuple[int, ...] | None:
    """A set with a piece of length j that is at least as good as any other set with it, if that can be shown.

    A set dominates another one if the other's pieces beside j fit, in groups, into the places of its own.
    """
    room = len(left) - 1 - j
    others = left.copy()
    others[j] -= 1
    there = np.flatnonzero(others)
    smallest = np.repeat(there[:3], np.minimum(others[there[:3]], 3))[:3]
    if not len(smallest) or smallest[0] > room:
        return (j,)  # nothing fits beside it
    largest = int(there[there <= room][-1])
    if largest == room or smallest[:2].sum() > room or len(smallest) < 2:
        return j, largest  # it fills the sequence, or only one piece fits and this is the largest
    if len(smallest) > 2 and smallest.sum() <= room:
        return None
    # at most two pieces fit beside j
    fitting = there[there <= room]
    floor = np.zeros(len(left), np.int64)  # the largest piece up to a length
    floor[there] = there
    floor = np.maximum.accumulate(floor)
    second = floor[np.minimum(room - fitting, fitting)]
    alone = (second == fitting) & (others[fitting] < 2)
    second[alone] = floor[second[alone] - 1]
    sums = np.where(second > 0, fitting + second, 0)
    if largest >= sums.max():
        return j, largest
    with_largest = others.copy()
    with_largest[largest] -= 1
    rest = np.flatnonzero(with_largest[: room - largest + 1])
    if not len(rest):
        return None
    third = int(rest[-1])
    longer = there[there > third]
    two = np.repeat(longer[:2], np.minimum(others[longer[:2]], 2))[:2]
    return (j, largest, third) if len(two) < 2 or two.sum() > room else None


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing length: each piece goes to the fullest sequence that it still fits into."""
    capacity = len(left) - 1
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            room = min((r for r in open_by_room if r >= length), default=None)
            pattern, count = open_by_room[room].pop() if room is not None else ((), todo)
            if room is not None and not open_by_room[room]:
                del open_by_room[room]
            space = capacity if room is None else room
            each = space // length
            full = min(count, todo // each)
            if not full:  # the last pieces go to one sequence
                each, full = todo, 1
            if room is not None and count > full:
                open_by_room.setdefault(room, []).append((pattern, count - full))
            open_by_room.setdefault(space - each * length, []).append((pattern + (length,) * each, full))
            todo -= each * full
    return [group for groups in open_by_room.values() for group in groups]

"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents fall into blocks. A block is an inverted index of the terms that some query has: the documents of each
term, in order of their ids, with the term's frequency in them. All statistics are counted over all blocks.

A block is searched for one query after the other. The query's terms are taken rarest first; each adds its part to
the accumulators of its documents, new ones included, until the terms that are left cannot together lift a new
document to the k-th best partial score. From then on no accumulator is made, and the survivors are updated exactly.
The k-th best score of the blocks that a task has done already counts as well. Every block gives at most k hits a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from docsift.llm.common import batch_of, stored

TOP = 20
QUERY_BYTES = 8_000_000  # texts of queries that travel with the tasks at once
BLOCK_DOCS, BLOCK_TERMS = 1 << 14, 1_500_000  # a block ends with the document that reaches one of them
RANK_GROUPS = 1024  # hits are ranked within so many groups of tasks before the last ranking
# Lower-cases A-Z and makes a space of every ASCII character that is no digit or letter.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def _block(schema: pa.Schema, ids: list, counts: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
    """One row: the documents of a block in order of their ids (null first) and the postings of each term."""
    docs = pa.chunked_array(ids).combine_chunks()
    order = pc.sort_indices(docs, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = np.concatenate(codes).astype(np.int64)
    owner = np.repeat(place, counts)
    known = code >= 0
    keys, tfs = np.unique(code[known] << 32 | owner[known], return_counts=True)
    terms, sizes = np.unique(keys >> 32, return_counts=True)
    columns = [docs.take(pa.array(order)), np.asarray(counts)[order], terms, sizes, keys & 0xFFFFFFFF, tfs]
    return pa.RecordBatch.from_arrays(
        [pa.array([values], field.type) if isinstance(values, np.ndarray) else pa.ListArray.from_arrays([0, len(values)], values).cast(field.type)
         for values, field in zip(columns, schema, strict=True)], schema=schema)


def index_blocks(docs: DataFrame, id_column: str, text_column: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per block: its ``docs`` and their ``lengths`` in terms, the numbers of its ``terms`` and the ``sizes`` of
    their postings, and one after the other the ``places`` (in ``docs``) and frequencies ``tfs`` of all postings."""
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, ids, counts, codes, terms = shared.value.get, [], [], [], 0
        schema = None
        for batch in batches:
            schema = pa.schema([("docs", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), *[
                (name, pa.list_(pa.int32())) for name in ("terms", "sizes", "places", "tfs")
            ]])
            begin = 0
            for at, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                codes.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                counts.append(len(words))
                terms += len(words)
                if len(counts) >= BLOCK_DOCS or terms >= BLOCK_TERMS:
                    yield _block(schema, [*ids, batch.column(0)[begin : at + 1]], counts, codes)
                    begin, ids, counts, codes, terms = at + 1, [], [], [], 0
            if begin < batch.num_rows:
                ids.append(batch.column(0)[begin:])
        if counts:
            yield _block(schema, ids, counts, codes)

    kind = dict(rows.dtypes)["doc"]
    return rows.mapInArrow(work, f"docs array<{kind}>, lengths array<bigint>, terms array<int>, sizes array<int>, places array<int>, tfs array<int>")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_parts(lengths: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """The part m of each document: 75 and 25 times its length by the average length, rounded down."""
    if 25 * int(lengths.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * lengths * documents // occurrences
    return np.array([75 + 25 * n * documents // occurrences for n in lengths.tolist()], np.int64)


class Block:
    """The postings of a block with the impact of each and the greatest impact of each term."""

    def __init__(self, lengths, terms, sizes, places, tfs, documents: int, occurrences: int):
        self.docs, self.terms, self.places = len(lengths), terms, places
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        parts = length_parts(lengths.astype(np.int64), documents, occurrences) if documents else lengths
        tfs = tfs.astype(np.int64)
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * parts[places])
        self.greatest = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(terms) else self.impacts
        self.scores = np.zeros(self.docs, np.int64)
        self.made = self.updated = 0  # accumulators, and updates of accumulators

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents, best first; of those below ``known`` some may be missing.

        ``terms`` come rarest first. ``known`` is a score that k documents of other blocks have.
        """
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[there], weights[there]
        bounds = weights * self.greatest[at]
        left = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])
        scores, step, floor = self.scores, 0, known
        scores[:] = 0
        while step < len(at) and left[step] >= floor:
            begin, end = self.starts[at[step]], self.starts[at[step] + 1]
            scores[self.places[begin:end]] += weights[step] * self.impacts[begin:end]
            self.updated += end - begin
            step += 1
            # no partial score is above left[0] - left[step]
            if k <= self.docs and floor <= left[step] < left[0] - left[step]:
                floor = max(floor, int(np.partition(scores, self.docs - k)[self.docs - k]))
        alive = np.flatnonzero(scores)
        self.made += len(alive)
        for later in range(step, len(at)):
            alive = alive[scores[alive] + left[later] >= floor]
            begin, end = self.starts[at[later]], self.starts[at[later] + 1]
            places = self.places[begin:end]
            found = np.minimum(np.searchsorted(places, alive), end - begin - 1)
            hit = places[found] == alive
            scores[alive[hit]] += weights[later] * self.impacts[begin:end][found[hit]]
            self.updated += int(hit.sum())
        alive = alive[scores[alive] >= max(floor, 1)]
        best = alive[np.lexsort((alive, -scores[alive]))[:k]]
        return best, scores[best].copy()


def _found(blocks: DataFrame, asked: list[tuple], k: int, documents: int, occurrences: int, kinds: tuple[str, str]) -> DataFrame:
    """``query``, ``item``, ``doc`` and ``score`` of the hits of every block; ``asked``: item, terms and weights of each query."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)
    fields = ("lengths", "terms", "sizes", "places", "tfs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [np.zeros(0, np.int64)] * len(asked)
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values
                block = Block(*[batch.column(f)[row].values.to_numpy() for f in fields], documents, occurrences)
                queries, places, scores = [], [], []
                for q, (_, terms, weights) in enumerate(asked):
                    own, found = block.search(terms, weights, k, int(best[q][-1]) if len(best[q]) == k else 1)
                    best[q] = np.sort(np.concatenate([best[q], found]))[::-1][:k]
                    queries.append(np.full(len(own), q))
                    places.append(own)
                    scores.append(found)
                queries = np.concatenate(queries) if queries else np.zeros(0, np.int64)
                if not len(queries):
                    continue
                items = pa.array([asked[q][0] for q in queries.tolist()], item_type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries, pa.int64()), items, docs.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))],
                    names=["query", "item", "doc", "score"],
                )

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[0]]
    return blocks.mapInArrow(work, f"query bigint, item {kinds[0]}, doc {kinds[1]}, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = (F.desc("score"), F.asc("doc"))
    few = found.withColumn("part", F.spark_partition_id() % RANK_GROUPS)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    every = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return every.where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def ranked_search(
    docs: DataFrame, id_column: str, text_column: str, queries: DataFrame, item_column: str, query_column: str,
    k: int = TOP, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``item``, ``rank``, ``doc`` and ``score``: the ``k`` documents with the highest scores above 0 for every query.

    Equal scores are ranked by ascending id, null ids first. Every row of ``docs`` is a document of its own, also if
    ids or texts repeat; null and empty texts have no terms and are never found. Query rows equal in id and text are
    one query, others with the same id are ranked apart; queries without terms find nothing. Ids of queries are
    integers or strings. Whole texts are read; other columns are not.

    Queries travel with the tasks, at most about ``query_bytes`` of text at once; more are asked in several rounds, each
    with a pass over the documents. A task holds one block.
    """
    texts = F.coalesce(queries[f"`{query_column}`"].cast("string"), F.lit(""))
    asks = queries.select(queries[f"`{item_column}`"].alias("item"), texts.cast("binary").alias("text")).where(F.length("text") > 0).distinct()
    rounds = max(1, -(-(asks.agg(F.sum(F.length("text"))).head()[0] or 0) // query_bytes))
    found = None
    for n in range(rounds):
        mine = asks.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == n).collect()  # about query_bytes
        own = _one_round(docs, id_column, text_column, mine, dict(asks.dtypes)["item"], k)
        found = own if found is None else found.unionAll(own)
    return found


def _one_round(docs: DataFrame, id_column: str, text_column: str, asks: list, item_kind: str, k: int) -> DataFrame:
    wanted = [(row["item"], Counter(terms_of(bytes(row["text"])))) for row in asks]
    vocabulary = {term: n for n, term in enumerate(sorted({term for _, terms in wanted for term in terms}))}
    blocks = stored(index_blocks(docs, id_column, text_column, vocabulary), "postings")
    each = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n)
    holding = F.size(F.filter("lengths", lambda n: n > 0))
    sums = blocks.agg(F.sum(holding).alias("documents"), F.sum(each).alias("occurrences")).head()
    documents, occurrences = sums["documents"] or 0, sums["occurrences"] or 0
    postings = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df"))
    df = {row["terms"]: row["df"] for row in postings.collect()}  # terms of these queries only
    asked = []
    for item, terms in wanted:
        known = sorted((df[vocabulary[term]], vocabulary[term], times) for term, times in terms.items() if vocabulary[term] in df)
        weights = [term_weight(documents, holding) * times for holding, _, times in known]
        asked.append((item, np.array([n for _, n, _ in known], np.int32), np.array(weights, np.int64)))
    kind = dict(blocks.dtypes)["docs"].removeprefix("array<")[:-1]
    return _ranked(_found(blocks, asked, k, documents, occurrences, (item_kind, kind)), k)

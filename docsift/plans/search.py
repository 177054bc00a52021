"""Free-text and vector search: neighbours, filters, pages, snippets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions.files import match_target
from docsift.functions.text import is_blank, is_empty, py_strip
from docsift.operators.embed import Embedder, embed, hashed_embedding
from docsift.functions.vectors import l2_squared, literal_vector
from docsift.operators.neighbours import SCORE_DIGITS, nearest, nearest_to_one, score_summary
from docsift.operators.paging import page_info, page_of
from docsift.operators.snippets import with_snippets
from docsift.schema import row_key
from docsift.session import MAX_PUSHED_IDS, written

# Up to this many hits are sent to every executor to pick their documents.
MAX_BROADCAST_HITS = 1_000_000


@dataclass(frozen=True)
class SearchOptions:
    """``threshold_mode`` says what the score threshold keeps.

    Scores are distances. ``reference`` keeps ``score >= threshold``, which is
    what the tool being matched does although it drops the closest hits;
    ``max_distance`` keeps ``score <= threshold``. All filters hold before the
    hits are ranked and counted, so that pages are full and totals complete.
    """

    page: int = 1
    page_size: int = 10
    min_content_length: int = 10
    score_threshold: float = 0.1
    threshold_mode: str = "reference"
    filter_empty: bool = True

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size

    @property
    def last(self) -> int:
        """Number of the last hit of the page."""
        return self.offset + self.page_size

    @property
    def limits(self) -> tuple[float, float]:
        """The least and the most score of a hit."""
        if self.threshold_mode == "reference":
            return self.score_threshold, float("inf")
        if self.threshold_mode == "max_distance":
            return float("-inf"), self.score_threshold
        raise ValueError(f"unknown threshold mode: {self.threshold_mode}")

    def keeps(self, score: Column) -> Column:
        return score.between(*self.limits)


def long_enough(content: Column, minimum: int) -> Column:
    return F.length(py_strip(content)) >= minimum


def vector_hits(
    corpus: DataFrame, vector: Sequence[float], options: SearchOptions = SearchOptions(), id_col: str = "doc_id", vector_col: str = "embedding"
) -> DataFrame:
    """Ranked hits of one vector that pass the score filter, up to the end of the page."""
    return nearest_to_one(corpus, vector, options.last, id_col, vector_col, limits=options.limits)


def vector_page(corpus: DataFrame, vector: Sequence[float], options: SearchOptions = SearchOptions(), **columns) -> DataFrame:
    return page_of(vector_hits(corpus, vector, options, **columns), options.page, options.page_size)


def vector_page_info(
    corpus: DataFrame, vector: Sequence[float], options: SearchOptions = SearchOptions(), id_col: str = "doc_id", vector_col: str = "embedding"
) -> DataFrame:
    """Page numbers over all hits, from one scan and without ranking them."""
    rows = corpus.filter(F.size(vector_col) == len(vector))
    score = F.round(l2_squared(F.col(vector_col), literal_vector(vector)), SCORE_DIGITS)
    return page_info(rows.filter(options.keeps(score)), options.page, options.page_size)


def debug_hits(corpus: DataFrame, vector: Sequence[float], k: int, content: str | None = None, **columns) -> DataFrame:
    """Raw neighbours without filters; with ``content`` its preview and length and what else is known of the file."""
    found = nearest_to_one(corpus, vector, k, **columns)
    if content is None:
        return found
    texts = corpus.select(
        F.col(columns.get("id_col", "doc_id")).alias("doc_id"),
        *[name for name in ("filename", "path", "type") if name in corpus.columns],
        F.substring(content, 1, 150).alias("content_preview"),
        F.length(content).cast("bigint").alias("content_length"),
    )
    # The hits are k rows.
    return texts.join(F.broadcast(found), "doc_id")


def debug_hits_of_many(
    corpus: DataFrame, queries: DataFrame, k: int, content: str, id_col: str = "doc_id", vector_col: str = "embedding"
) -> DataFrame:
    """``debug_hits`` of every query (``query_id``, ``embedding``): its raw neighbours with a preview, the length and the file."""
    found = nearest(corpus, queries, k, id_col=id_col, vector_col=vector_col)
    texts = corpus.select(
        F.col(id_col).alias("doc_id"),
        *[name for name in ("filename", "path", "type") if name in corpus.columns],
        F.substring(content, 1, 150).alias("content_preview"),
        F.length(content).cast("bigint").alias("content_length"),
    )
    return found.join(texts, "doc_id")


def valid_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """Blank queries are ignored."""
    return queries.filter(~is_blank(F.col(query)))


def _bounded(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def text_hits(
    corpus: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    embedder: Embedder = hashed_embedding,
) -> DataFrame:
    """``query_id``, key, ``score`` and ``rank`` of the hits that pass all filters, up to the end of the page.

    ``corpus`` holds documents with their vectors; the key is ``row_id`` where
    it has one, so that copies of a document are hits of their own, else
    ``doc_id``, which must then be unique. Neighbours are found from
    ids and vectors alone. Stored documents carry ``is_empty`` and
    ``text_chars``, so that the filters need no content either; for other
    tables they are computed from ``content``.
    """
    asked = embed(valid_queries(queries), "query", "embedding", embedder)
    key = row_key(corpus)
    found = nearest(usable_documents(corpus, options), asked, options.last, id_col=key, limits=options.limits)
    return found.withColumnRenamed("doc_id", key).select("query_id", key, "score", "rank")


def usable_documents(corpus: DataFrame, options: SearchOptions) -> DataFrame:
    """Documents that can be hits at all."""
    if not options.filter_empty:
        return corpus
    stored = {"is_empty", "text_chars"} <= set(corpus.columns)
    empty = F.col("is_empty") if stored else is_empty(F.col("content"))
    chars = F.col("text_chars") if stored else F.length(py_strip(F.col("content")))
    return corpus.filter(~empty & (chars >= options.min_content_length))


def hit_totals(
    corpus: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), embedder: Embedder = hashed_embedding
) -> DataFrame:
    """``query_id, hits, nearest, farthest`` over all hits of every query, not only those of a page."""
    asked = embed(valid_queries(queries), "query", "embedding", embedder)
    return score_summary(usable_documents(corpus, options), asked, options.limits, id_col=row_key(corpus))


def with_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Join hits, which should be stored as they are read three times, with their documents.

    Few ids are looked up by value, which the Parquet scan turns into skipped
    row groups; otherwise the table is scanned once.
    """
    key, docs = row_key(corpus), corpus.drop("embedding")
    ids = [row[0] for row in hits.select(key).distinct().limit(MAX_PUSHED_IDS + 1).collect()]
    if len(ids) <= MAX_PUSHED_IDS:
        docs = docs.filter(F.col(key).isin(ids))
    return docs.join(F.broadcast(hits) if _bounded(hits, MAX_BROADCAST_HITS) else hits, key)


def text_search(
    corpus: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    embedder: Embedder = hashed_embedding,
) -> DataFrame:
    """One page of hits per query, with their documents and snippets.

    Snippets come last because they change no filter: only the page is matched.
    The page, a few rows per query, is written to the shared folder, first its
    ids and then its documents, since later steps read each of them twice.
    """
    page = written(page_of(text_hits(corpus, queries, options, embedder), options.page, options.page_size), "page-ids")
    asked = with_documents(page, corpus).join(valid_queries(queries).select("query_id", "query"), "query_id")
    asked = written(asked, "page-documents")
    target = match_target(F.col("match_source"), F.col("content"), F.col("filename"), F.col("path"))
    return with_snippets(asked, ["query_id", row_key(corpus)], target, F.col("query"))
